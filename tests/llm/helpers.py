"""Small corpora with every awkward case, and plain statements of what the queries return."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

WORDS = re.compile("[^ \t\n\x0b\x0c\r]+")
#: The documents columns, and others whose names the operators also use inside or return.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("fp", T.StringType()),
        T.StructField("digest", T.IntegerType()),
        T.StructField("keep_id", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("part", T.StringType()),
        T.StructField("group_size", T.StringType()),
    ]
)


def frame(spark, rows: list[tuple], partitions: int = 3):
    """rows of (doc_id, text) as documents with clashing extra columns."""
    full = [(i, t, None if i is None else "en", None, None if t is None else len(t), "x", 1, "k", "no", "p", "g") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Epsilon", "zeta,", "eta.", "thêta", "iota", "kappa", "λ", "mu", "nu"]) + str(rng.randint(0, 40)) for _ in range(n))


def awkward() -> list[tuple]:
    long_text = prose(5, 6000)
    shared = prose(6, 70)
    return [
        (1, None),
        (2, ""),
        (3, "  \t\n "),
        (4, "one"),
        (5, "One two three"),
        (6, "one two three"),
        (7, prose(7, 200)),
        (8, prose(7, 200)),
        (9, prose(7, 200) + " more"),
        (9, prose(7, 200) + " more"),
        (10, long_text),
        (11, long_text[:-3]),
        (12, prose(12, 30) + " " + shared + " " + prose(13, 30)),
        (13, shared + "\n" + prose(14, 60)),
        (14, prose(15, 20) + "  " + shared),
        (None, prose(16, 80)),
        (None, prose(7, 200)),
        (15, " non breaking space é中文 \U0001f600"),
        (16, "same line\nsame line\n\nsame line\n other"),
        (17, "go go go go go go go go go go go go"),
    ]
