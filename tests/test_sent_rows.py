"""What travels between tasks: known items with their features, fused lists, neighbours of the ends of pairs."""

import random

from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.operators import nearest
from loomgraph.operators import similar as S


def rows_sent(spark, run):
    """Result of ``run`` and the number of rows that it wrote to shuffles."""
    sc = spark.sparkContext
    store, gateway = sc._jsc.sc().statusStore(), sc._gateway

    def total():
        nothing = gateway.jvm.java.util.ArrayList()
        stages = store.stageList(nothing, False, False, gateway.new_array(gateway.jvm.double, 0), nothing)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    out = run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return out, total() - before


def _known_case(spark):
    rng = random.Random(7)
    features = {i: set(rng.sample(range(40), rng.randint(0, 12))) for i in range(90)}
    candidates = [(c, i) for c in range(6) for i in rng.sample(range(90), 30)]
    truth = [(c, i) for c in range(8) for i in rng.sample(range(90), 60)]
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    f = frame([(i, x) for i, xs in features.items() for x in xs], "item bigint, feature bigint")
    want = {}
    for c, i in candidates:
        scores = []
        for d, k in truth:
            if d == c and k != i:
                union = len(features[i] | features[k])
                scores.append((round(len(features[i] & features[k]) / union, 6) if union else 0.0, -k))
        best = max(scores)
        want[c, i] = (best[0], -best[1], sum(s > 0.7 for s, _ in scores), sum(s > 0.5 for s, _ in scores))
    return frame(candidates, "context bigint, item bigint"), frame(truth, "context bigint, item bigint"), f, want


def _best(df):
    return {(r["context"], r["item"]): (r["best"], r["best_match"], r["above_70"], r["above_50"]) for r in df.collect()}


def test_best_known_match_sends_items_and_not_pairs(spark):
    candidates, truth, features, want = _known_case(spark)
    got, sent = rows_sent(spark, lambda: _best(S.best_known_match(candidates, truth, features)))
    assert got == want
    assert sent < 6 * 30 * 60 / 2  # a row per pair before, several times


def test_best_known_match_with_slices_and_large_sets(spark):
    candidates, truth, features, want = _known_case(spark)
    assert _best(S.best_known_match(candidates, truth, features, rows=5)) == want


def test_fused_lists_travel_once(spark):
    from loomgraph.operators import fuse as FU

    rows = [(m, c, (c * 7 + 3 * r + k) % 50, float(31 - r), r) for k, m in enumerate(("a", "b", "c")) for c in range(40) for r in range(1, 31)]
    preds = spark.createDataFrame(rows, "model string, context bigint, item bigint, score double, rank int")
    got, sent = rows_sent(spark, lambda: FU.fused_scores(preds, 3).select("context", "item", "mean", "borda", "worst_rank").collect())
    assert sent <= len(rows)  # the lists, their sizes and the partial aggregates before
    want = {}
    for m, c, i, s, r in rows:
        want.setdefault((c, i), []).append((s, 31 - r, r))
    assert {(r["context"], r["item"]): (r["mean"], r["borda"], r["worst_rank"]) for r in got} == {
        key: (round(sum(x[0] for x in v) / len(v), 9), round(sum(x[1] for x in v) / len(v), 9), max(x[2] for x in v)) for key, v in want.items()}


def test_only_neighbours_of_the_ends_look_up_their_weight(spark):
    from loomgraph.operators import graph as G

    rows = [(f"Item::{i}", "targets", f"Feature::{(i * 13 + j) % 500}") for i in range(400) for j in range(20)]
    edges = spark.createDataFrame(rows, "source string, relation string, target string")
    pairs = spark.createDataFrame([("Item::1", "Item::2"), ("Item::1", "Item::3")], "a string, b string")
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, sent = rows_sent(spark, lambda: G.pair_topology(pairs, edges, "a", "b").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert {(r["b"], r["n_common"]) for r in got} == {("Item::2", 7), ("Item::3", 0)}
    # all 16,000 rows meet when they become distinct and when the ends pick theirs, the degrees are partial sums of them
    assert sent < 42_000


def test_walkers_meet_one_row_a_node(spark):
    from loomgraph.operators import graph as G

    rows = [(f"Item::{i}", "targets", f"Feature::{(i * 13 + j) % 50}") for i in range(200) for j in range(30)] + [("Item::1", "self", "Item::1"), ("Feature::13", "back", "Item::1")]
    edges = spark.createDataFrame(rows, "source string, relation string, target string")
    near = {}
    for a, _, b in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, sent = rows_sent(spark, lambda: G.random_walks(edges, 1, 6, cut_every=3).collect())
        hubs = G.random_walks(edges, 1, 6, cut_every=3, rows=40).collect()  # the features are hubs, the items are not
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert sorted(got) == sorted(hubs)
    trail = {(r["start"], r["step"]): r["node"] for r in got}
    assert len(got) == len(trail) == 250 * 7
    import hashlib

    for (start, step), node in trail.items():
        if step:
            at = sorted(near[trail[start, step - 1]])
            assert node == at[int(hashlib.md5(f"42:{start}:1:{step}".encode()).hexdigest()[:8], 16) % len(at)]
    # the 6,000 links meet the names of their ends and each other, both directions are packed once, then nodes meet walkers;
    # before, the 12,000 neighbours were sent once a step
    assert sent < 50_000


def test_only_the_ends_of_pairs_send_their_members(spark):
    from loomgraph.operators.pairs import common_members

    left = spark.createDataFrame([(a, (a * 7 + j) % 90) for a in range(400) for j in range(15)], "a bigint, mid bigint")
    right = spark.createDataFrame([(b, (b * 11 + j) % 90) for b in range(400) for j in range(15)], "b bigint, mid bigint")
    pairs = spark.createDataFrame([(1, 1), (1, 2), (3, 500), (2, 2), (2, 2)], "a bigint, b bigint")
    hold = lambda k, e: {(e * k + j) % 90 for j in range(15)}
    want = {(a, b): hold(7, a) & hold(11, b) for a, b in ((1, 1), (1, 2), (2, 2))}
    got, sent = rows_sent(spark, lambda: S.pair_sizes(pairs, left, right, "a", "b", "mid").collect())
    assert sorted((r["a"], r["b"], r["size_a"], r["size_b"], r["shared"]) for r in got) == sorted(
        [(a, b, 15, 15, len(want[a, b])) for a, b in ((1, 1), (1, 2), (2, 2), (2, 2))] + [(3, 500, 15, 0, 0)])
    wide = S.pair_sizes(pairs.unionByName(spark.createDataFrame([(None, 2)], "a bigint, b bigint")).withColumn("x", F.lit("x")), left, right, "a", "b", "mid")
    assert set(wide.columns) == {"a", "b", "x", "size_a", "size_b", "shared"}
    assert sorted((r["a"] or 0, r["b"], r["size_a"], r["size_b"], r["shared"]) for r in wide.collect()) == sorted(
        [(0, 2, 0, 15, 0)] + [(r["a"], r["b"], r["size_a"], r["size_b"], r["shared"]) for r in got])
    met, more = rows_sent(spark, lambda: common_members(pairs, left, right, "a", "b", "mid").collect())
    assert sorted(map(tuple, met)) == sorted((a, b, m) for (a, b), ms in want.items() for m in ms)
    assert sent < 400 and more < 400  # sets of all 800 ends before


def test_members_travel_once_with_their_set(spark):
    # 40 sets of 31 members at most: the distinct before the packing was a shuffle of its own
    lines = spark.range(3000).selectExpr("id % 40 as id", "(id div 40) % 25 + id % 7 as feature").repartition(4)
    packed, sent = rows_sent(spark, lambda: nearest._packed_sets(lines.distinct(), []).collect())
    want = {r["id"]: sorted(r["f"]) for r in lines.groupBy("id").agg(F.collect_set("feature").alias("f")).collect()}
    assert {r["id"]: r["features"] for r in packed} == want
    assert sent <= 3000 + 4 * 40 + 40


def test_coverage_counts_repeated_rows_once(spark):
    lists = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (1, 9), (2, 9)], "context int, feature int")
    items = spark.createDataFrame([(7, 5), (7, 6), (7, 6), (8, 9), (8, 5), (8, 1)], "item int, feature int")
    got = sorted(tuple(r) for r in G.coverage_ranking(lists, items).collect())
    assert got == [(1, 7, 2, 0.666667, 1.0, 1), (1, 8, 2, 0.666667, 0.666667, 2), (2, 8, 1, 1.0, 0.333333, 1)]


def test_rows_of_a_vote_travel_once(spark):
    # one shuffle by context; it was one by (context, item) and a second one for the ranking
    near = spark.range(600).selectExpr("id div 20 as context", "id % 20 as neighbour", "(id % 7) / 10.0D as similarity").repartition(4)
    truth = spark.range(400).selectExpr("id % 20 as context", "id as item").repartition(4)
    run = lambda: S.top_n(S.vote(F.broadcast(near), truth), ["context"], "score", "item", 30).collect()
    got, sent = rows_sent(spark, run)
    assert len(got) == 30 * 30 and sent <= 600 + 400 + 12000 + 100


def test_one_comparison_gives_the_neighbours_with_and_without_the_context(spark, monkeypatch):
    from __spark_entry__ import queries as registered

    queries = registered()
    rng = random.Random(5)
    vectors = spark.createDataFrame([(i, [float(rng.randint(0, 2)) for _ in range(3)]) for i in range(60)], "context int, vec array<double>")
    truth = spark.createDataFrame([(i, i) for i in range(0, 60, 2)], "context int, item int")
    both = S.nearest_contexts(vectors, truth, 5)
    alone = sorted(map(tuple, S.nearest_contexts(vectors, truth, 4, exclude_self=True).collect()))
    assert sorted(map(tuple, S.without_self(both, 4).select("context", "neighbour", "similarity", "place").collect())) == alone
    calls = []
    compared = S.nearest_contexts
    monkeypatch.setattr(S, "nearest_contexts", lambda *a, **k: calls.append(1) or compared(*a, **k))
    queries["u4_membership_changes"](spark, "/root/testdata/sf0.001")
    queries["a17_group_profile"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 2  # one each
