"""Pairs met from the smaller end, paths searched from both ends, and p-values as Columns."""

import itertools
import math
import random

from pyspark.sql import functions as F

from loomgraph.operators import evaluate as E
from loomgraph.operators import graph as G
from loomgraph.operators import paths as P
from loomgraph.operators.pairs import PairMembers, linked
from loomgraph.operators.similar import pair_sizes


def hub_tables(spark, big=3000, small=40):
    """End 0 of either side has ``big`` members, the others three each."""
    left = spark.range(big).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("m")).union(
        spark.range(1, small).select(F.col("id").alias("a"), F.explode(F.array(F.col("id"), F.col("id") + 1, F.lit(7).cast("long"))).alias("m")).distinct())
    right = left.select(F.col("a").alias("b"), F.col("m"))
    pairs = spark.range(small).crossJoin(spark.range(small).withColumnRenamed("id", "b")).select(F.col("id").alias("a"), "b")
    return pairs, left, right


def test_hubs_cost_what_their_partner_holds(spark):
    pairs, left, right = hub_tables(spark)
    members = PairMembers(left, right, "a", "b", "m", rows=64)
    sized = members.sized(pairs)
    expanded = members.expanded(sized)
    # 40 x 40 pairs, of which only (0, 0) lays out the hub
    assert expanded.count() <= 3000 + 40 * 40 * 3
    most = expanded.join(members.sizes, ["__side", "__end"]).where("__end = 0").groupBy("__far").count().agg(F.max("count")).first()[0]
    assert most == 3000
    sets = {}
    for r in left.collect():
        sets.setdefault(r["a"], set()).add(r["m"])
    got = {}
    for r in members.common(sized).collect():
        got.setdefault((r["a"], r["b"]), []).append(r["m"])
    for a, b in itertools.product(range(40), range(40)):
        assert sorted(got.get((a, b), [])) == sorted(sets[a] & sets[b])
    assert {(r["a"], r["b"]) for r in linked(pairs, members).collect()} == {(a, b) for a in range(40) for b in range(40) if b in sets[a]}


def test_pair_sizes_with_empty_ends_and_repeated_pairs(spark):
    pairs = spark.createDataFrame([(1, 2, "x"), (1, 2, "y"), (1, 9, "z"), (8, 9, "w")], "a long, b long, tag string")
    left = spark.createDataFrame([(1, 5), (1, 6)], "a long, feature long")
    right = spark.createDataFrame([(2, 6), (2, 7), (2, 8)], "b long, feature long")
    got = sorted((r["tag"], r["size_a"], r["size_b"], r["shared"]) for r in pair_sizes(pairs, left, right, "a", "b").collect())
    assert got == [("w", 0, 0, 0), ("x", 2, 3, 1), ("y", 2, 3, 1), ("z", 2, 0, 0)]


def test_topology_counts(spark):
    edges = spark.createDataFrame([("I::1", "Feature::a"), ("Feature::a", "C::1"), ("I::1", "Feature::b"), ("C::1", "Feature::b"), ("I::1", "C::1"), ("I::2", "Feature::a")], "source string, target string")
    r = G.pair_topology(spark.createDataFrame([("I::1", "C::1")], "s string, t string"), edges, "s", "t").first()
    assert (r["degree_a"], r["degree_b"], r["n_common"], r["n_common_features"], r["direct"], r["features_a"]) == (3, 3, 2, 2, 1, 2)
    assert r["adamic_adar"] == round(1 / math.log(3) + 1 / math.log(2), 4)


def plain_search(net, source, depth):
    """Least shortest path to every node within depth."""
    best, front = {source: [source]}, [source]
    for _ in range(depth):
        new = {}
        for x in front:
            for y in net.get(x, ()):
                if y not in best:
                    new[y] = min(new.get(y, [math.inf]), best[x] + [y])
        best |= new
        front = list(new)
    return best


def test_two_ended_search(spark):
    rnd = random.Random(1)
    edges = {(rnd.randrange(60), rnd.randrange(60)) for _ in range(70)} | {(0, k) for k in range(1, 25)}  # node 0 is a hub
    net = {}
    for a, b in edges:
        net.setdefault(a, set()).add(b)
        net.setdefault(b, set()).add(a)
    table = spark.createDataFrame(sorted(edges), "a long, b long")
    wanted = [(a, b) for a in range(0, 60, 7) for b in range(60)]
    pairs = spark.createDataFrame(wanted, "source long, target long")
    for depth in (3, 4):
        got = {(r["source"], r["target"]): (r["path"], r["length"]) for r in P.shortest_paths(pairs, table, depth).collect()}
        assert len(got) == len(wanted)
        for a, b in wanted:
            path = plain_search(net, a, depth).get(b)
            assert got[a, b] == ((path, len(path) - 1) if path else (None, None))


def test_set_distances_and_depth(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(8)], "a long, b long")
    starts = spark.createDataFrame([("k", 0), ("k", 8), ("m", 4)], "key string, feature long").withColumn("key", F.when(F.col("key") == "k", 1).otherwise(2).cast("long"))
    wanted = spark.createDataFrame([(1, i) for i in range(9)] + [(2, 0), (2, 77)], "key long, node long")
    got = {(r["key"], r["node"]): r["distance"] for r in P.set_distances(wanted, starts, chain, "key", 3).collect()}
    assert got == {(1, i): min(i, 8 - i) for i in range(9) if min(i, 8 - i) <= 3}


def test_ends_grow_half_the_way(spark, monkeypatch):
    """From a source in a chain of hubs no layer goes deeper than half the depth."""
    grown = []
    real = P._grow
    monkeypatch.setattr(P, "_grow", lambda front, seen, step, key, path: grown.append(key) or real(front, seen, step, key, path))
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "a long, b long")
    P.shortest_paths(spark.createDataFrame([(0, 4)], "source long, target long"), chain, 4)
    assert grown == ["source", "target", "source", "target"]
    grown.clear()
    P.shortest_paths(spark.createDataFrame([(0, 1)], "source long, target long"), chain, 4)
    assert grown == ["source"]  # met pairs stop the search


def test_p_values(spark):
    zs = [0.0, 0.1, -0.7, 1.96, -3.3, 5.9, 12.0]
    got = [r["p"] for r in E.with_normal_p(spark.createDataFrame([(z,) for z in zs] + [(None,)], "z double")).collect()]
    assert got[:-1] == [round(math.erfc(abs(z) / math.sqrt(2)), 9) + 0.0 for z in zs] and got[-1] is None
    cases = [(0, 0), (5, 1), (0, 9), (9, 0), (40, 60), (60, 40), (500, 480), (5200, 5000)]
    rows = E.with_sign_p(spark.createDataFrame(cases, "first_only bigint, second_only bigint")).collect()
    for (x, y), r in zip(cases, rows):
        n = x + y
        assert r["p"] == round(sum(math.comb(n, i) for i in range(x, n + 1)) / 2**n, 9)
