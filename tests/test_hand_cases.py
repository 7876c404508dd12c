"""The hand cases of FIXTURES.md, part C, and skewed inputs against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import cleanse as C
from loomgraph.operators import evaluate as E
from loomgraph.operators import fuse as FU
from loomgraph.operators import names as N
from loomgraph.operators import nearest
from loomgraph.operators import paths as P
from loomgraph.operators import ranking as W
from loomgraph.operators import rules as R
from loomgraph.operators import similar as S


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_name_normaliser_keeps_inner_blank(spark):
    df = spark.createDataFrame([(" Crohn's  disease_type-A.; ",), ("x .",)], "name string")
    got = [r[0] for r in df.select(T.normal_context_name(F.col("name"))).collect()]
    assert got == ["crohns disease type a", "x "]


def test_cascade_match_steps(spark):
    long20, long21 = "a" * 20, "b" * 10 + " mapped name one"
    mapped = spark.createDataFrame([("Exact Name", "id1"), ("canon form", "id2"), ("mapped name one", "id3"), ("aaaaaaaaaaaa", "id4")], "name string, id string")
    names = spark.createDataFrame([("exact-name",), ("synonym x",), (long20,), (long21,), ("nothing",)], "name string")
    got = {r["name"]: (r["id"], r["step"]) for r in N.cascade_match(names, mapped, {"synonym x": "canon form"}).collect()}
    assert got == {"exact-name": ("id1", 1), "synonym x": ("id2", 2), long20: (None, None), long21: ("id3", 4), "nothing": (None, None)}


def test_contains_join_is_exact(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab ") for _ in range(12)) for _ in range(60)] + ["common " * 3] * 30
    needles = ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    n = spark.createDataFrame([(x,) for x in needles], "n string")
    want = sorted({(x, y) for x in texts for y in needles if y in x})
    assert rows(N.contains_join(t, "t", n, "n", 3, short=True), "t", "n") == want


def test_short_codes_need_word_boundaries(spark):
    df = spark.createDataFrame([("small cell",), ("ALL relapse",)], "name string")
    got = [r[0] for r in df.select(R.word_types(F.col("name"), {"all": ["all"]})).collect()]
    assert got == [[], ["all"]]


def test_first_rule_wins_and_audit_lists_all(spark):
    rules = [R.Rule("a", F.col("x") > 5, "LOW"), R.Rule("b", F.col("x") > 3, "HIGH"), R.Rule("c", F.col("x") > 1, "GOLDEN")]
    row = spark.createDataFrame([(6,)], "x int").select(R.first_match(rules, "FILTER").alias("w"), R.all_matches(rules).alias("m")).first()
    assert (row.w.tier, row.w.rule) == ("LOW", "a")
    assert [m.rule for m in row.m] == ["a", "b", "c"]
    none = spark.createDataFrame([(0,)], "x int").select(R.first_match(rules, "FILTER").alias("w"), R.all_matches(rules).alias("m")).first()
    assert none.w.tier == "FILTER" and none.m == []


def test_equal_similarity_keeps_lower_id(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "id bigint, vec array<double>")
    c = spark.createDataFrame([(9, [1.0, 0.0]), (4, [2.0, 0.0]), (7, [0.0, 1.0])], "id bigint, vec array<double>")
    assert rows(nearest.nearest_vectors(q, c, 1), "context", "neighbour") == [(1, 4)]


@pytest.mark.parametrize("block_rows", [7, 8192])
def test_nearest_vectors_against_brute_force_on_copies(spark, block_rows):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 5))
    v[:20] = v[0]  # a third of all rows are copies
    data = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    df = spark.createDataFrame(data, "id bigint, vec array<double>")
    got = rows(nearest.nearest_vectors(df, df, 4, exclude_self=True, block_rows=block_rows), "context", "place", "neighbour")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = []
    for i in range(60):
        sims = sorted(((-round(float(u[i] @ u[j]), 6), j) for j in range(60) if j != i))[:4]
        want += [(i, p + 1, j) for p, (_, j) in enumerate(sims)]
    assert got == sorted(want)


@pytest.mark.parametrize("metric", ["overlap", "jaccard"])
def test_nearest_sets_against_brute_force_with_hot_feature(spark, metric):
    rng = random.Random(5)
    sets = {i: {0} | {rng.randint(1, 30) for _ in range(rng.randint(1, 8))} for i in range(40)}  # feature 0 is in every set
    df = spark.createDataFrame([(i, f) for i, s in sets.items() for f in s], "id bigint, feature bigint")
    got = rows(nearest.nearest_sets(df, df, 3, metric=metric, exclude_self=True, block_rows=9), "context", "place", "neighbour")
    want = []
    for i, a in sets.items():
        def score(j):
            n = len(a & sets[j])
            return n if metric == "overlap" else round(n / len(a | sets[j]), 6)
        best = sorted(((-score(j), j) for j in sets if j != i and a & sets[j]))[:3]
        want += [(i, p + 1, j) for p, (_, j) in enumerate(best)]
    assert got == sorted(want)


def test_groups_do_not_mix_and_hot_group_is_split(spark):
    data = [(i, [float(i % 7), 1.0], "hot" if i < 40 else f"g{i % 3}") for i in range(60)]
    df = spark.createDataFrame(data, "id bigint, vec array<double>, g string")
    out = nearest.nearest_vectors(df, df, 2, by=["g"], exclude_self=True, block_rows=8).collect()
    group = {i: g for i, _, g in data}
    assert all(group[r["context"]] == group[r["neighbour"]] == r["g"] for r in out)
    assert len([r for r in out if r["g"] == "hot"]) == 80


def test_vote_sums_similarities(spark):
    near = spark.createDataFrame([(0, 10, 0.5), (0, 11, 0.25)], "context bigint, neighbour bigint, similarity double")
    truth = spark.createDataFrame([(10, 1), (10, 2), (11, 2)], "context bigint, item bigint")
    assert rows(S.vote(near, truth), "item", "score") == [(1, 0.5), (2, 0.75)]


def test_subsample_of_everything_equals_the_plain_vote(spark):
    v = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(12)], "context bigint, vec array<double>")
    truth = spark.createDataFrame([(i, i % 4) for i in range(12)], "context bigint, item bigint")
    plain = S.vote(S.nearest_contexts(v, truth, 3), truth)
    full = S.subsample_votes(v, truth, draws=3, ratio=1.0, k=3)
    a = {(r.context, r.item): round(r.score, 5) for r in plain.collect()}
    assert a == {(r.context, r.item): round(r.score, 5) for r in full.collect()}


def test_jaccard_edge_cases(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 5)], "a bigint, b bigint")
    left = spark.createDataFrame([(1, 7), (1, 8)], "a bigint, feature bigint")
    right = spark.createDataFrame([(2, 7), (2, 8), (3, 9)], "b bigint, feature bigint")
    assert rows(S.pair_jaccard(pairs, left, right, "a", "b"), "a", "b", "jaccard") == [(1, 2, 1.0), (1, 3, 0.0), (4, 5, 0.0)]


def test_borda_and_reciprocal_rank(spark):
    m1 = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.8, 2), (0, 3, 0.7, 3)], "context bigint, item bigint, score double, rank int")
    m2 = spark.createDataFrame([(0, 2, 5.0, 1), (0, 1, 4.0, 2)], "context bigint, item bigint, score double, rank int")
    got = {r.item: (r.borda, r.reciprocal) for r in FU.fused_scores(FU.stacked({"m1": m1, "m2": m2}), 2).collect()}
    assert got[1][0] == got[2][0] == 2.0 and got[3][0] == 1.0
    assert got[1][1] == got[2][1] == round(1 / 61 + 1 / 62, 9) and got[3][1] == round(1 / 63, 9)
    assert rows(FU.min_rank(m1, m2), "item", "min_rank") == [(1, 1), (2, 1), (3, 3)]


def test_name_groups_covered_by_id_groups_are_dropped(spark):
    by_id = spark.createDataFrame([("K", "x", "s", "b"), ("K", "y", "s", "b")], "key string, id string, source string, base string")
    by_name = spark.createDataFrame([("N1", "y", "s", None), ("N1", "z", "s", None), ("N2", "p", "s", None), ("N2", "q", "t", None)], by_id.schema)
    assert rows(C.merged_duplicates(by_name, by_id), "key", "match_type", "confidence") == [("K", "external_id", 0.95), ("N2", "name", 0.65)]


def test_orphan_with_two_missing_ends_counts_twice(spark):
    e = spark.createDataFrame([("a", "b"), ("u", "v")], "source string, target string")
    n = spark.createDataFrame([("a",), ("b",)], "id string")
    r = C.orphan_edges(e, n).first()
    assert (r.no_source, r.no_target, r.no_end, r.total, r.edges) == (1, 1, 1, 2, 1)


def test_shortest_path_depth(spark):
    net = spark.createDataFrame([(i, i + 1) for i in range(5)], "a bigint, b bigint")
    pairs = spark.createDataFrame([(0, 4), (0, 5)], "source bigint, target bigint")
    got = {r.target: r.length for r in P.shortest_paths(pairs, net, 4).collect()}
    assert got == {4: 4, 5: None}


def test_simple_paths_on_a_triangle(spark):
    e = spark.createDataFrame([("A", "r", "B"), ("A", "s", "B"), ("B", "r", "C"), ("A", "r", "C"), ("C", "r", "A")], "source string, relation string, target string")
    got = P.simple_paths(spark.createDataFrame([("A", "C")], "source string, target string"), e, 3).collect()
    assert sorted((r.length, tuple(r.nodes), tuple(r.relations)) for r in got) == [(1, ("A", "C"), ("r",)), (2, ("A", "B", "C"), ("r", "r"))]


def test_micro_and_macro_recall(spark):
    truth = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (2, 3)], "context bigint, item bigint")
    hits = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "context bigint, item bigint, hit int")
    r = E.recall(hits, truth, truth.select("context")).first()
    assert (r.micro, r.macro) == (0.5, round((1 + 1 / 3) / 2, 6))


def test_small_bucket_is_skipped_by_the_cutoff(spark):
    data = [("c", rank, 1) for rank in [1] * 12] + [("c", 7, 0)] * 3 + [("c", 12, 1)] * 12 + [("c", 17, 0)] * 12 + [("c", 22, 1)] * 12
    df = spark.createDataFrame(data, "category string, rank int, hit int")
    assert rows(E.rank_cutoffs(df, "category"), "cutoff") == [(15,)]


def test_halves_inside_groups(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.9), (2, 2, 0.8), (2, 3, 0.7)], "context bigint, item bigint, score double")
    got = {(r.context, r.item): r.half for r in W.halves(df, ["context"], "score", "item").collect()}
    assert got == {(1, 1): "top", (2, 1): "top", (2, 2): "bottom", (2, 3): "bottom"}


def test_global_position_with_hot_value(spark):
    df = spark.createDataFrame([(i, 5 if i % 3 == 0 else i) for i in range(90)], "id bigint, v bigint")
    got = sorted((r.position, r.id) for r in W.global_position(df, [F.col("v"), F.col("id")]).collect())
    want = sorted(((5 if i % 3 == 0 else i), i) for i in range(90))
    assert got == [(p + 1, i) for p, (_, i) in enumerate(want)]


def test_average_rank_and_auc_against_brute_force(spark):
    rng = random.Random(2)
    data = [(i, round(rng.random(), 1), int(rng.random() < 0.4)) for i in range(80)]
    df = spark.createDataFrame(data, "id bigint, s double, y int")
    r = E.auc(df, "s", "y", ["id"]).first()
    pos, neg = [s for _, s, y in data if y], [s for _, s, y in data if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(r.auroc - want) < 1e-5
    order = sorted(data, key=lambda d: (-d[1], d[0]))
    hits, total = 0, 0.0
    for place, (_, _, y) in enumerate(order, 1):
        hits += y
        total += y * hits / place
    assert abs(r.auprc - total / len(pos)) < 1e-5


def test_trailing_run(spark):
    df = spark.createDataFrame([("a", 1, "N"), ("a", 2, "K"), ("a", 3, "N"), ("a", 4, "N"), ("b", 1, "K"), ("c", 1, "N")], "k string, seq int, s string")
    assert rows(W.trailing_run(df, ["k"], "seq", F.col("s") != "N"), "k", "run") == [("a", 2), ("b", 0), ("c", 1)]


def test_sign_test_p(spark):
    r = E.with_sign_p(spark.createDataFrame([(5, 1)], "first_only bigint, second_only bigint")).first()
    assert abs(r.p - 7 / 64) < 1e-9
