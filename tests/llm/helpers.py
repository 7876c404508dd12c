"""Small tables and plain versions shared by the tests."""

import os
import re
from zlib import crc32

FOLDER = "/root/testdata/sf0.001"
HAVE = os.path.isdir(FOLDER)
LONG = " ".join(f"word{i % 997} of" for i in range(30_000))
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One two"), (6, "the same text here now"), (7, "the  same\ttext here now"), (7, "the  same\ttext here now"),
    (8, LONG), (9, LONG + " end"), (10, "naïve Σ ΟΔΟΣ 中文 😀 don't <|endoftext|> x"), (11, "a@b.cc +1 (555) 123-4567 10.0.0.1 4111 1111 1111 1111"), (None, "the same text here now"), (None, None),
]
#: Names that operators use inside.
CLASHES = ["digest", "fp", "key", "block", "score", "kept", "place", "label", "component_id", "spans", "n_tokens", "_stay", "_id", "lang", "sha", "_sha", "_kept_id", "rows", "train"]


def odd(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, "doc_id long, text string").select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)))


def empty(spark):
    return odd(spark).limit(0)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def held_out(key, folds, out):
    return key is not None and crc32(str(key).encode()) % folds == out


def groups(links, nodes):
    """Smallest node that each node reaches, by plain union-find."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
