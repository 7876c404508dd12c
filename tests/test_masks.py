"""Sets over few features are compared by their bits, not feature by feature."""

import random

import pytest

from loomgraph.operators import nearest


@pytest.mark.parametrize("features", [25, 70])
def test_dense_overlap_is_exact(spark, monkeypatch, features):
    monkeypatch.setattr(nearest, "MASK_TILE", 32)
    rng = random.Random(features)
    queries = {c: rng.sample(range(features + 2), rng.randint(0, features)) for c in range(40)}
    corpus = {i: rng.sample(range(features), rng.randint(0, features)) for i in range(300)}
    frame = lambda sets: spark.createDataFrame([(i, f) for i, fs in sets.items() for f in fs + fs[:1]], "id bigint, feature bigint")
    got = nearest.nearest_sets(frame(queries), frame(corpus), 7, metric="overlap", names=("context", "item", "score")).collect()
    want = set()
    for c, q in queries.items():
        best = sorted((-len(set(q) & set(s)), i) for i, s in corpus.items() if set(q) & set(s))[:7]
        want |= {(c, i, float(-n), r) for r, (n, i) in enumerate(best, 1)}
    assert {(r["context"], r["item"], r["score"], r["place"]) for r in got} == want


def test_masks_and_postings_agree_and_small_sets_are_left_out():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.sort(rng.choice(90, rng.integers(0, 60), replace=False)) for _ in range(500)]
    size, members = np.array([len(s) for s in sets]), np.concatenate(sets)
    posts = nearest._Postings(size, members)
    bits = nearest._masks(np.repeat(np.arange(500), size), members, posts.feature, 500)
    assert int(np.bitwise_count(bits).sum()) == len(members)
    assert posts.total(members) == sum(len(np.intersect1d(a, b)) for a in sets for b in sets)
    looked = []
    for row, best, both in nearest._best_by_masks(bits[:, :20], bits, size, 5):
        looked.append(row)
        every = sorted((-len(np.intersect1d(sets[row], s)), i) for i, s in enumerate(sets) if len(np.intersect1d(sets[row], s)))[:5]
        assert sorted(zip(-both, best)) == every
    assert looked == list(range(20))


def test_dense_overlap_lays_out_no_shared_rows(spark, monkeypatch):
    """12 groups, sets of 10: each pair shares 8 or more; before, each of them was laid out as a row."""
    laid = []
    real = nearest._laid_out
    monkeypatch.setattr(nearest, "_laid_out", lambda first, width: laid.append(int(width.sum())) or real(first, width))
    import pyarrow as pa

    rng = random.Random(2)
    sets = pa.table({"id": list(range(80)), "features": [sorted(rng.sample(range(12), 10)) for _ in range(80)]})

    class Kernel(Exception):
        pass

    def stop(self, kernel, schema):
        raise Kernel(kernel)

    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", stop)
    frame = spark.createDataFrame([(i, f) for i in range(3) for f in range(3)], "id bigint, feature bigint")
    with pytest.raises(Kernel) as got:
        nearest.nearest_sets(frame, frame, 4, metric="overlap")
    out = got.value.args[0](sets, sets)
    assert out.num_rows == 80 * 4
    assert sum(laid) == 0
