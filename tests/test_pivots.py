"""The pivot index against the comparison of all pairs, and draws against one comparison per draw."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import nearest as N
from loomgraph.operators import pivots as P
from loomgraph.operators import similar as S


def clusters(spark, n=240, centres=12, dims=8, spread=0.05, seed=1):
    rnd = np.random.default_rng(seed)
    c = rnd.normal(size=(centres, dims))
    which = np.where(np.arange(n) % 3 == 0, 0, rnd.integers(centres, size=n))  # a third in one cluster
    v = c[which] + rnd.normal(size=(n, dims)) * spread
    v[5] = v[8]  # equal rows
    v[11] = 0.0
    rows = [(i, x.tolist(), f"c{i % 4}") for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "id long, vec array<double>, category string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("options", [
    {"k": 5}, {"k": 5, "exclude_self": True}, {"k": 100}, {"k": 7, "metric": "euclid"}, {"k": 7, "boosted": ["c1", "c2"], "boost": 0.3},
])
def test_pruned_equals_all_pairs(spark, options):
    points = clusters(spark)
    want = rows(N.nearest_vectors(points, points, **options))
    assert rows(P.nearest_pruned(points, points, block_rows=80, **options)) == want


def test_pruned_on_empty_sides(spark):
    points = clusters(spark, 50)
    none = points.limit(0)
    assert P.nearest_pruned(points, none, 3).collect() == [] == P.nearest_pruned(none, points, 3, block_rows=8).collect()


def test_far_blocks_are_skipped(spark):
    points = clusters(spark, spread=0.01)
    index = P.PivotIndex(points.select("id", "vec"), block_rows=80)
    queries = points.select("id", "vec")
    first = index.first_visits(queries, 5)
    near = N.nearest_vectors(queries, queries, 5, names=("id", "c", "cut")).where("place = 5").select("id", "cut")
    later = index.later_visits(queries.join(near, "id", "left"), 5)
    all_visits = 240 * int((index.size > 0).sum())
    asked = first.count() + later.count()
    assert asked < all_visits / 3, (asked, all_visits)
    assert index.size.sum() == 240 and len(index.pivots) <= P.MOST_PIVOTS


def test_contexts_switch_gives_the_same_rows(spark):
    points = clusters(spark, 300).select(F.col("id").alias("context"), "vec", "category")
    truth = points.where("context % 2 = 0").select("context", (F.col("context") % 9).alias("item"))
    want = rows(S.nearest_contexts(points, truth, 4))
    assert rows(S.nearest_contexts(points, truth, 4, block_rows=32)) == want


@pytest.mark.parametrize("block_rows", [8192, 40])
def test_draws_equal_one_join_each(spark, block_rows):
    points = clusters(spark, 200)
    mask = F.expr("(xxhash64(id) & 7) | if(id % 50 = 0, 0, 8)")
    corpus = points.withColumn("draws", mask)
    got = N.nearest_by_draw(points, corpus, 6, 4, exclude_self=True, block_rows=block_rows)
    for d in range(4):
        bit = lambda c: F.expr(f"shiftright({c}, {d}) & 1") == 1
        want = N.nearest_vectors(points, corpus.where(bit("draws")), 6, exclude_self=True).drop("place")
        assert rows(got.where(bit("draws")).select("q_id", "c_id", "score")) == rows(want)


def test_cuts_of_one_query_are_counted_together(spark):
    points = clusters(spark, 150).select("id", "vec")
    q = points.where("id < 20").withColumn("cuts", F.array(F.lit(-0.5), F.lit(-2.0), F.lit(0.0)))
    got = {(r["id"], r["cut"]): r["better"] for r in N.count_better(q, points, block_rows=40).collect()}
    v = {r["id"]: np.array(r["vec"]) for r in points.collect()}
    for (i, cut), better in got.items():
        assert better == sum(round(-float(np.linalg.norm(v[i] - x)), 6) + 0.0 > cut for x in v.values())
    assert len(got) == 60
    pruned = {(r["id"], r["cut"]): r["better"] for r in P.count_better_pruned(q, points, block_rows=40).collect()}
    assert pruned == got


@pytest.mark.parametrize("block_rows", [8192, 60])
def test_labels_above_a_floor(spark, monkeypatch, block_rows):
    monkeypatch.setattr(P, "_LABELS", 5)
    monkeypatch.setattr(P, "EXPANSION", 50)
    points = clusters(spark, 160).select("id", "vec")
    labels = points.where("id % 3 > 0").select("id", F.explode(F.expr("if(id = 1, sequence(0, 40), array(id % 7, id % 11))")).alias("label"))
    near = N.nearest_vectors(points, points, 1000, floor=0.9, names=("q_id", "id", "s"))
    want = rows(near.join(labels, "id").select("q_id", "label").distinct())
    assert rows(P.labels_above(points, points, labels, 0.9, block_rows=block_rows)) == want
    assert P.labels_above(points, points, labels.limit(0), 0.9).collect() == []
