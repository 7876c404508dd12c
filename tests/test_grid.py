"""Vectors without clusters: the grid gives the rows of the index, and a task makes a bounded number of visits."""

import numpy as np
import pytest

from loomgraph.operators import nearest, pivots


def points(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((n, 12)))], "id bigint, vec array<double>")


@pytest.mark.parametrize("few", [0.0, 1.0])
def test_grid_and_index_agree(spark, monkeypatch, few):
    df = points(spark).cache()
    want = sorted(map(tuple, nearest.nearest_vectors(df, df, 3, exclude_self=True).collect()))
    monkeypatch.setattr(pivots, "FEW_VISITS", few)
    visited = []
    compared = pivots._compared
    monkeypatch.setattr(pivots, "_compared", lambda *a: visited.append(1) or compared(*a))
    assert sorted(map(tuple, pivots.nearest_pruned(df, df, 3, exclude_self=True, block_rows=20).collect())) == want
    assert len(visited) == (2 if few else 1)  # no second round over the blocks where nothing is ruled out


@pytest.mark.parametrize("few", [0.0, 1.0])
def test_labels_and_counts_agree(spark, monkeypatch, few):
    df = points(spark).cache()
    labels = df.selectExpr("id", "id % 5 as label")
    monkeypatch.setattr(pivots, "FEW_VISITS", few)
    v = {r["id"]: np.array(r["vec"]) for r in df.collect()}
    cos = lambda a, b: round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6)
    want = sorted({(i, j % 5) for i in v for j in v if cos(v[i], v[j]) >= 0.5})
    assert sorted(map(tuple, pivots.labels_above(df, df, labels, 0.5, block_rows=20).collect())) == want
    asked = df.selectExpr("id", "vec", "array(-3.0D, -4.0D) as cuts")
    got = sorted(map(tuple, pivots.count_better_pruned(asked, df, block_rows=20).collect()))
    assert got == sorted(map(tuple, nearest.count_better(asked, df).collect()))


def test_a_batch_is_cut_where_blocks_are_many(spark, monkeypatch):
    monkeypatch.setattr(pivots, "_VISITS", 64)
    df = points(spark, 100)
    index = pivots.PivotIndex(df, block_rows=10)
    assert len(index.pivots) == 40
    asked = index.first_visits(df, 100).cache()  # every block
    assert asked.count() == 100 * len(index.pivots)
    import pyarrow as pa

    assert max(b.num_rows for b in pivots._parts([pa.record_batch({"x": range(100)})], 40)) == 1
