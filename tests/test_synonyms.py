"""Synonyms and substring matches as joins, against plain loops."""

import random

from pyspark.sql import functions as F

from loomgraph.operators import names as N


def plain(name, table, least=6):
    for s, c in table:
        if s == name:
            return c
    for s, c in table:
        if len(s) >= least and (s in name or len(name) >= least and name in s):
            return c
    return name


def test_table_order_decides(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    table = [(word(rng.randint(1, 9)), f"c{i}") for i in range(120)]
    names = [word(rng.randint(0, 14)) for _ in range(150)] + [s for s, _ in table[:20]]
    known = spark.createDataFrame([(i, s, c) for i, (s, c) in enumerate(table)] + [(999, None, "x")], "place long, synonym string, canonical string")
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    got = {r["name"]: r["canon"] for r in N.canonical(df, "name", known).collect()}
    assert got.pop(None) is None
    assert got == {n: plain(n, table) for n in names}


def test_plan_does_not_grow_with_the_table(spark):
    df = spark.createDataFrame([("some name",)], "name string")
    size = []
    for n in (5, 5000):
        table = N.synonym_table(spark, {f"synonym {i}": f"form {i}" for i in range(n)})
        size.append(len(N.canonical(df, "name", table)._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(size[0] - size[1]) < 200


def test_anchor_is_rare_among_texts(spark):
    """A gram that is in every text anchors no needle that has a rarer one."""
    texts = spark.range(300).select(F.concat(F.lit("xyz"), F.col("id").cast("string")).alias("t"))
    needles = spark.createDataFrame([("xyz17",), ("xyz299",), ("xyz!",), ("qxyz",)], "n string")
    assert sorted(r["t"] + "/" + r["n"] for r in N.contains_join(texts, "t", needles, "n").collect()) == sorted(
        [f"xyz{i}/xyz17" for i in (17, *range(170, 180))] + ["xyz299/xyz299"]
    )
    met = N.anchored(texts, "t", needles, "n")
    assert met.count() <= 40
