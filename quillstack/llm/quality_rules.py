"""Quality rules with a hashed n-gram likelihood ratio, in DataFrame operations only.

Words and pairs of neighbouring words are hashed into ``BUCKETS``. Two multinomials over the buckets are counted: the raw corpus,
over every document, and the trusted target, over documents labelled of good quality. A document's verdict is the mean over its
n-grams of log((target + prior) / (expected + prior)), where expected is the raw count scaled to the target's size: about zero or more
for text like the target, well below it for text that the target lacks. Every document is held against the same threshold.

The target is fitted on the labelled rows of good quality, at most ``max_target`` of them (in hash order of their ids), so that the set
of their ids has a bounded size and is broadcast; the raw counts cover the whole corpus. The weights, one number a bucket, come back
to the scan as a scalar subquery.

Base rules: fewer than ``min_words`` words, or more than a fifth of the words inside repeated five-word windows.

Defined cases: null and empty texts have no words and fail the base rules; rows that repeat a doc_id are judged each; without labels the
ratio is zero everywhere and the base rules decide; a document's n-grams and windows are taken over its whole text; an empty table gives
no rows; other columns are carried by ``keep_good`` and ignored by ``judge``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

BUCKETS = 1 << 16
MAX_TARGET = 20_000
PRIOR = 2.0
#: Mean log-likelihood ratio below which a document goes.
THRESHOLD = -0.25
WINDOW = 5
MIN_WORDS = 10

GAPS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"


def words_of(text: Column) -> Column:
    """Words of a text between ASCII white space."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAPS))


def _prepared(docs: DataFrame, text_col: str) -> DataFrame:
    """The input with __text, __words and __hashes (a 64-bit hash a word)."""
    rows = docs.withColumn("__text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = rows.withColumn("__words", words_of(F.col("__text")))
    return rows.withColumn("__hashes", F.transform("__words", lambda w: F.xxhash64(w)))


def _pairs(hashes: Column) -> Column:
    """Hashes of neighbouring words; none for fewer than two."""
    n = F.size(hashes)
    left = F.slice(hashes, F.lit(1), F.greatest(n - 1, F.lit(0)))
    right = F.slice(hashes, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.zip_with(left, right, lambda a, b: F.xxhash64(a, b))


def target_ids(labels: DataFrame, max_target: int = MAX_TARGET) -> DataFrame:
    """Ids (__target) of at most max_target documents of good quality, in hash order: a set of bounded size."""
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("__target")).where("__target IS NOT NULL")
    return good.distinct().orderBy(F.xxhash64("__target"), "__target").limit(max_target)


def bucket_weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, max_target: int = MAX_TARGET, prior: float = PRIOR) -> DataFrame:
    """One row (weights): the log ratio of each bucket, by bucket."""
    rows = _prepared(docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__in")), "__in")
    marked = rows.join(F.broadcast(target_ids(labels, max_target)), F.col("__id") == F.col("__target"), "left")
    grams = marked.select(F.col("__target").isNotNull().cast("long").alias("good"), F.explode(F.concat("__hashes", _pairs(F.col("__hashes")))).alias("h"))
    counts = grams.groupBy(F.pmod("h", F.lit(buckets)).cast("int").alias("bucket")).agg(F.count("*").alias("raw"), F.sum("good").alias("target"))
    sums = counts.agg(F.sum("raw").alias("raw_all"), F.sum("target").alias("target_all"), F.collect_list(F.struct("bucket", "raw", "target")).alias("all"))
    expected = F.col("x.raw") * F.col("target_all") / F.col("raw_all")
    ratio = F.when(F.col("x.bucket").isNotNull(), F.log((F.col("x.target") + F.lit(prior)) / (expected + F.lit(prior)))).otherwise(F.lit(0.0))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("slot"))
    seen = sums.select("raw_all", "target_all", F.explode("all").alias("x"))
    filled = every.join(seen, F.col("slot") == F.col("x.bucket"), "left").select("slot", ratio.alias("w"))
    return filled.agg(F.array_sort(F.collect_list(F.struct("slot", "w"))).alias("s")).select(F.transform("s", lambda s: s["w"]).alias("weights"))


def _repeated(hashes: Column) -> Column:
    """Words inside five-word windows found twice or more."""
    n = F.size(hashes)
    at = lambda i, k: F.get(hashes, i + F.lit(k))
    windows = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - F.lit(WINDOW)), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))
    )
    return windows


def _covered(windows: Column) -> Column:
    """Length of the union of [i, i + 5) over the repeated windows, from the sorted (hash, place) pairs."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def union(p: Column) -> Column:
        same = lambda k: F.get(p, k)["h"]
        repeated = F.filter(F.transform(p, lambda x, k: F.when(x["h"].eqNullSafe(same(k - 1)) | x["h"].eqNullSafe(same(k + 1)), x["i"])), lambda i: i.isNotNull())
        starts = F.array_sort(repeated)
        return F.aggregate(
            starts,
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")),
            lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(i - acc["last"], F.lit(WINDOW))).alias("sum")),
            lambda acc: acc["sum"],
        )

    return F.get(F.transform(F.array(pairs), union), F.lit(0))


def _judged(docs: DataFrame, weights: DataFrame, text_col: str, buckets: int, threshold: float) -> DataFrame:
    """The input's columns and the rules' columns."""
    rows = _prepared(docs, text_col).withColumn("__windows", _repeated(F.col("__hashes")))
    score = lambda grams: F.aggregate(grams, F.lit(0.0), lambda acc, h: acc + F.get(F.col("__weights"), F.pmod(h, F.lit(buckets)).cast("int")))
    rows = rows.withColumn("__weights", weights.scalar())
    n = F.size("__words").cast("long")
    lines = F.filter(F.split("__text", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    rows = rows.withColumns(
        {
            "n_words": n,
            "word_chars": F.length(F.regexp_replace("__text", GAPS, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace("__text", SYMBOLS, "")).cast("long"),
            "__lines": lines,
            "n_repeat_words": F.when(F.size(F.array_distinct("__windows")) == F.size("__windows"), F.lit(0)).otherwise(_covered(F.col("__windows"))).cast("long"),
            "__sum": score(F.col("__hashes")) + score(_pairs(F.col("__hashes"))),
        }
    )
    rows = rows.withColumns(
        {
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "base_failed": (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20),
            "llr": F.when(F.col("n_words") > 0, F.col("__sum") / (F.col("n_words") * 2 - 1)).otherwise(F.lit(0.0)),
        }
    )
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD, max_target: int = MAX_TARGET) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr."""
    weights = bucket_weights(docs, labels, id_col, text_col, buckets, max_target)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__in"))
    return _judged(rows, weights, "__in", buckets, threshold).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD, max_target: int = MAX_TARGET) -> DataFrame:
    """The input's rows and columns that are kept."""
    weights = bucket_weights(docs, labels, id_col, text_col, buckets, max_target)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(text_col).alias("__in"))
    judged = _judged(rows, weights, "__in", buckets, threshold)
    # the row number keeps the filter above the rules: pushed below, it would repeat their arrays inside every lambda
    return judged.withColumn("__no", F.monotonically_increasing_id()).where("kept AND __no >= 0").select("__row.*")
