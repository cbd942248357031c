"""Incremental updates: what changed between two states of a post table, and the merge of the two.

Both sides are flat posts hashed over one canonical projection, so an unchanged post is unchanged. One full outer join on the URL serves the
difference, the merge and the orphans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash


def with_hash(posts: DataFrame) -> DataFrame:
    """Posts with ``content_hash``; the last row of a URL counts."""
    hashed = posts.withColumn("content_hash", content_hash(F.col("title"), F.col("content_html"), F.col("excerpt"), F.col("categories"), F.col("tags")))
    return hashed.withColumn("__n", F.row_number().over(Window.partitionBy("url").orderBy(F.col("pos").desc()))).where("__n = 1").drop("__n")


def diff(old: DataFrame, new: DataFrame, key: str = "url", digest: str = "content_hash", modified: str | None = None, since=None) -> DataFrame:
    """(key, status): new, changed, unchanged or removed.

    With ``since``, rows of the new side modified before it are unchanged without a look at their digest; rows without a date are compared.
    """
    a = old.select(F.col(key).alias("__a"), F.col(digest).alias("__ha"))
    b = new.select(F.col(key).alias("__b"), F.col(digest).alias("__hb"), (F.col(modified) if modified else F.lit(None)).alias("__m"))
    before = (F.col("__m") < F.lit(since)) if since is not None else F.lit(False)
    status = (
        F.when(F.col("__a").isNull(), "new")
        .when(F.col("__b").isNull(), "removed")
        .when(F.coalesce(before, F.lit(False)), "unchanged")
        .when(F.col("__ha").eqNullSafe(F.col("__hb")), "unchanged")
        .otherwise("changed")
    )
    return a.join(b, F.col("__a") == F.col("__b"), "full_outer").select(F.coalesce("__a", "__b").alias(key), status.alias("status"))


def diff_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count("*").alias("n"))


def merge(old: DataFrame, updates: DataFrame, key: str = "url", order: str = "pos") -> DataFrame:
    """Updated rows replace old ones by key and keep their place; new ones follow. Both sides have the same columns, one row a key."""
    columns = [c for c in old.columns if c != order]
    a = old.select(F.col(key).alias("__a"), F.col(order).alias("__pa"), F.struct(*columns).alias("__ra"))
    b = updates.select(F.col(key).alias("__b"), F.col(order).alias("__pb"), F.struct(*columns).alias("__rb"))
    both = a.join(b, F.col("__a") == F.col("__b"), "full_outer")
    row = F.when(F.col("__b").isNotNull(), F.col("__rb")).otherwise(F.col("__ra"))
    place = F.struct(F.col("__a").isNull().alias("added"), F.coalesce("__pa", "__pb").alias("at"))
    return both.select(row.alias("r"), place.alias("place")).select("r.*", F.col("place.added").alias("added"), F.col("place.at").alias(order))


def missing_keys(left: DataFrame, right: DataFrame, key: str = "url") -> DataFrame:
    """Keys of the left side that the right one lacks: orphans, or what is still to do."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def common_keys(left: DataFrame, right: DataFrame, key: str = "url") -> DataFrame:
    return left.select(key).intersect(right.select(key))


def keep_latest(log: DataFrame, order: str, n: int = 50, tie: str | None = None) -> DataFrame:
    """The n latest rows of a log."""
    return log.orderBy(F.col(order).desc(), *([F.col(tie).desc()] if tie else [])).limit(n)
