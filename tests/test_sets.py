"""Set joins: rounding of ties, sparse and dense counts, packed sets, and what is sent."""

import numpy as np
import pytest

from loomgraph.catalog import fusion
from loomgraph.operators import nearest


def test_scores_are_rounded_half_up(spark):
    # 13 of 128: 0.1015625, which the SQL twin rounds to 0.101563
    df = spark.createDataFrame([(i, f) for i, fs in ((1, range(70)), (2, range(57, 128))) for f in fs], "id bigint, feature bigint")
    got = nearest.nearest_sets(df, df, 5, exclude_self=True).collect()
    assert [(r["context"], r["neighbour"], r["similarity"]) for r in sorted(got)] == [(1, 2, 0.101563), (2, 1, 0.101563)]


@pytest.mark.parametrize("span", [50, 50_000_000])
def test_pairs_are_counted_alike_in_an_array_and_by_sorting(span):
    rng = np.random.default_rng(3)
    sets = nearest._Postings(np.zeros(0, np.int64), np.zeros(0, np.int64))
    sets.row = np.sort(rng.integers(0, span, 400)).astype(np.int32)
    row = np.sort(rng.integers(0, 7, 90))
    first = rng.integers(0, 390, 90)
    width = rng.integers(0, 10, 90)
    want = {}
    for q, f, w in zip(row, first, width):
        for c in sets.row[f : f + w]:
            want[q, c] = want.get((q, c), 0) + 1
    r, c, n = nearest._shared_counts(row, first, width, sets, 7)
    assert {(a, b): k for a, b, k in zip(r, c, n)} == want and len(r) == len(want)


def test_a_set_is_sent_once_for_each_large_block(spark):
    # 20000 sets of 3 were three blocks of 8192 before: each set of the other side was sent three times
    df = spark.range(60000).selectExpr("id div 3 as id", "id % 1000 as feature")
    left = nearest._packed_sets(df, [])
    a, b = nearest._set_cells(left, nearest._fresh(left), [], nearest.SET_ROWS)
    assert left.count() == 20000 == a.count()
    assert a.select("c_block").distinct().count() == 1 and b.count() <= 20000 * spark.sparkContext.defaultParallelism
    assert dict(left.dtypes)["features"] == "array<int>"


def test_mechanism_of_vectors_is_that_of_all_contexts(spark):
    from loomgraph.catalog.graph import mechanism, mechanism_of_vectors
    from loomgraph.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    want = mechanism(t).join(t.vectors().select("context"), "context", "left_semi")
    assert sorted(map(tuple, mechanism_of_vectors(t).collect())) == sorted(map(tuple, want.collect()))
    assert fusion.mech_of_vectors is mechanism_of_vectors
