"""What operators write and lay out: only what can still matter for the result."""

import collections
import hashlib
import itertools
import random

import pytest

from loomgraph.operators import evaluate as E
from loomgraph.operators import paths as P
from loomgraph.operators import similar as S


def _h(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


@pytest.fixture
def written(monkeypatch):
    """(columns, rows) of every table that the path searches write."""
    counts = []

    def cut(df, real=P.cut_lineage):
        out = real(df)
        counts.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(P, "cut_lineage", cut)
    return counts


def test_simple_paths_write_no_first_hop_that_misses_the_target(spark, written):
    edges = [("s", "a", f"f{i}") for i in range(60)] + [("f0", "b", "t"), ("f1", "c", "f0"), ("f1", "b", "f0"), ("f2", "b", "f1"), ("s", "a", "t")]
    edges += [(f"f{i}", "d", f"g{i}") for i in range(3, 60)] + [(f"i{i}", "a", "f0") for i in range(300)] + [(None, "a", "t"), ("s", "a", None)]
    edges += [(f"g{i}", "d", f"f{i}") for i in range(3, 60)]  # left and entered, but no way to the target
    pairs = spark.createDataFrame([("s", "t"), ("s", "t"), ("t", "t"), ("nobody", "t"), (None, "t")], "source string, target string")
    got = P.simple_paths(pairs, spark.createDataFrame(edges, "source string, relation string, target string"), 4, 3).collect()
    least = {}
    for x, r, y in edges:
        if x and y:
            least[x, y] = min(r, least.get((x, y), r))
    nodes = {n for e in least for n in e}
    want = sorted((len(p) - 1, list(p), [least[h] for h in itertools.pairwise(p)]) for p in (("s", *m, "t") for k in range(4) for m in itertools.permutations(sorted(nodes & {"f0", "f1", "f2", "f3", "g3", "i0"}), k)) if all(h in least for h in itertools.pairwise(p)))
    assert [(r["length"], r["nodes"], r["relations"]) for r in sorted(got, key=lambda r: r["place"])] == want[:3]
    assert {(r["source"], r["target"], r["n_paths"]) for r in got} == {("s", "t", len(want))}
    assert max(n for columns, n in written if "nodes" in columns) < 60  # a row for each of the 61 edges of s before


def test_class_transfer_lays_out_few_items_of_a_class(spark, monkeypatch):
    rng = random.Random(3)
    classes = [(i, f"c{i % 4}") for i in range(400)] + [(i, f"c{i % 3}") for i in range(0, 60, 5)] + [(7, "c3"), (8, None), (None, "c1"), (900, None)]
    near = [(c, 100 + (c + k) % 9, round(rng.choice([0.5, 0.25, 0.125, -0.5]), 6)) for c in range(12) for k in range(4)]
    truth = [(100 + d, i) for d in range(9) for i in rng.sample(range(400), 6)] + [(100, i) for i in range(3, 200, 4)]
    want = []
    for c in range(12):
        ref = [(i, s) for x, d, s in near if x == c for e, i in truth if e == d]
        lent = collections.Counter()
        for i, s in ref:
            for j, k in classes:
                if i == j and k:
                    lent[k] += s
        got = {}
        for j, k in classes:
            if k in lent:
                got[j] = got.get(j, 0) + round(lent[k], 6)
        left = sorted(((-round(s, 6), -1 if j is None else j) for j, s in got.items() if j not in {i for i, _ in ref}))[:5]
        want += [(c, None if j < 0 else j, -s, r) for r, (s, j) in enumerate(left, 1)]
    laid = []

    def top(df, *a, real=S.top_n, **kw):
        laid.append(df.count())
        return real(df, *a, **kw)

    monkeypatch.setattr(S, "top_n", top)
    frame = spark.createDataFrame
    out = S.class_transfer(
        frame(near, "context bigint, neighbour bigint, similarity double"), frame(truth, "context bigint, item bigint"), frame(classes, "item bigint, cls string"), 5, chunk=8)
    key = lambda r: (r[0], r[3])
    assert sorted([(r["context"], r["item"], r["score"], r["rank"]) for r in out.collect()], key=key) == sorted(want, key=key)
    assert laid[0] < 12 * 100  # nearly all of 12 contexts x 400 items before


def test_bootstrap_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def slow(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.createDataFrame([(k, float(k % 5)) for k in range(300)], "k bigint, v double")
    got = E.bootstrap_mean(df.mapInPandas(slow, df.schema), "k", "v", reps=40).collect()[0]
    order = sorted(range(300), key=lambda k: (_h(42, k), k))
    means = [sum(order[_h(42, r, j) % 300] % 5 for j in range(1, 301)) / 300 for r in range(1, 41)]
    assert (got["reps"], got["mean"]) == (40, round(sum(means) / 40, 6))
    assert round(min(means), 6) <= got["low"] <= got["high"] <= round(max(means), 6)
    assert seen.value == 300  # four times before


def test_last_layers_of_a_search_are_not_laid_out(spark, written):
    rng = random.Random(5)
    links = [(f"s{i}", f"h{rng.randrange(4)}") for i in range(12)] + [(f"t{i}", f"k{rng.randrange(4)}") for i in range(12)]
    links += [(f"h{j}", f"m{m}") for j in range(4) for m in range(300) if m % 5 != j] + [(f"k{j}", f"m{m}") for j in range(4) for m in range(200, 500) if m % 3 != j]
    links += [("s0", "h9"), ("h9", "k0"), ("t0", "h9"), ("lone", "x1"), ("x1", "x2")]
    near = collections.defaultdict(set)
    for x, y in links:
        near[x].add(y)
        near[y].add(x)
    wanted = [(f"s{i}", f"t{j}") for i in range(12) for j in range(12)] + [("lone", "t1"), ("s1", "lone"), ("s2", "nobody")]

    def least(s, t):
        layer = [(s,)]
        for _ in range(5):
            if met := [p for p in layer if p[-1] == t]:
                return list(min(met))
            layer = [(*p, y) for p in layer if len(p) < 5 for y in near[p[-1]] if y not in p]

    got = P.shortest_paths(spark.createDataFrame(wanted, "source string, target string"), spark.createDataFrame(links, "a string, b string"), 4).collect()
    assert {(r["source"], r["target"]): r["path"] for r in got} == {(s, t): least(s, t) for s, t in wanted}
    assert max(n for columns, n in written if "path" in columns) < 12 * 100  # 12 sources x about 240 nodes before


def test_set_distances_ask_only_whether_ends_meet(spark, monkeypatch):
    plans = []

    def cut(df, real=P.cut_lineage):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df)

    monkeypatch.setattr(P, "cut_lineage", cut)
    rng = random.Random(11)
    links = [(rng.randrange(50), rng.randrange(50)) for _ in range(60)]
    starts = [(k, n) for k in range(4) for n in rng.sample(range(50), 3)]
    wanted = [(k, n) for k in range(5) for n in range(52)]
    frame = spark.createDataFrame
    got = {(r["k"], r["node"]): r["distance"] for r in P.set_distances(frame(wanted * 2, "k long, node long"), frame(starts, "k long, feature long"), frame(links, "a long, b long"), "k", 3).collect()}
    want = {}
    for k in range(4):
        layer = {n for j, n in starts if j == k}
        for d in range(4):
            for n in layer:
                want.setdefault((k, n), d)
            layer |= {y for a, b in links for x, y in ((a, b), (b, a)) if x in layer}
    assert got == want
    assert not [p for p in plans if "array_intersect" in p or "explode" in p]  # each common member was a row before
