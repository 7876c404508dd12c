"""Exact and near dedup against plain versions."""

import random
import re
from hashlib import sha256

import duckdb
import numpy as np
import pytest
import xxhash

from loomgraph.llm import exact, simhash
from loomgraph.llm.components import components

from .helpers import FOLDER, HAVE, ODD, groups, odd, words

DATA = pytest.mark.skipif(not HAVE, reason="driver tables are missing")


def plain_fingerprint(text):
    found = words(text)
    parts = [b" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_exact_groups(spark):
    def digest(t):
        return sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()

    members = {}
    for i, t in ODD:
        members.setdefault(digest(t), []).append(i)
    keep = {h: min((i for i in m if i is not None), default=None) for h, m in members.items()}
    want = sorted((i or 0, keep[digest(t)], len(members[digest(t)]), i == keep[digest(t)], digest(t)) for i, t in ODD)
    for counters in (1, 2, 256):
        got = sorted((r[0] or 0, *r[1:]) for r in exact.groups(odd(spark), counters=counters).collect())
        assert got == want


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b"), (1, "a  b"), (2, "a b"), (2, "c"), (None, "a b"), (None, "d"), (None, "d"), (3, "e"), (1, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for counters in (1, 256):
        got = sorted((r[0] or 0, " ".join(r[1].split())) for r in exact.deduplicated(docs, counters).collect())
        assert got == [(0, "d"), (1, "a b"), (1, "e"), (2, "c")]


def test_frequent_digests_are_not_missed(spark):
    rng = random.Random(3)
    rows = [(bytes([min(rng.randrange(1, 40), rng.randrange(1, 40))] * 4),) for _ in range(3000)]
    table = spark.createDataFrame(rows, "digest binary").repartition(7)
    for k in (1, 3, 10):
        got = {bytes(r[0]) for r in exact.frequent(table, k).collect()}
        assert len(got) <= k
        assert {d for (d,) in rows if rows.count((d,)) * (k + 1) > len(rows)} <= got


@DATA
def test_exact_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    want = sorted(con.execute(f"select doc_id, keep_id, group_size, kept, text_sha256 from ({exact.SQL})").fetchall())
    assert sorted(map(tuple, exact.groups(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect())) == want


def test_fingerprints():
    texts = ["", " ", "a", "A b", "a b c", "a b c d", "x y z " * 50, "é ß Σ", "a\x0bb\x1cc\x85 d e"] + [t or "" for _, t in ODD if len(t or "") < 100]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_linked_fingerprints_share_an_anchor():
    rng = np.random.default_rng(5)
    fp = rng.integers(-(1 << 63), 1 << 63, 3000)
    rows, keys = simhash.anchors(fp)
    assert np.bincount(rows).max() <= 30
    at = {i: set() for i in range(len(fp))}
    for r, k in zip(rows, keys):
        at[r].add(k)
    for flips in (0, 1, 2, 3):
        other = fp.copy()
        for _ in range(flips):
            other ^= np.int64(1) << rng.integers(0, 64, len(fp))
        r2, k2 = simhash.anchors(other)
        met = np.zeros(len(fp), bool)
        for r, k in zip(r2, k2):
            met[r] |= k in at[r]
        assert met.all()


@pytest.mark.parametrize("cell", [4, 64, 4096])
def test_links_span_all_components(spark, cell):
    rng = np.random.default_rng(cell)
    base = rng.integers(-(1 << 63), 1 << 63, 12)
    fp = np.unique(np.concatenate([base, *(base[i % 3] ^ (np.int64(1) << rng.integers(0, 64, 60)) ^ (np.int64(1) << rng.integers(0, 12, 60)) for i in range(5))]))
    nodes = spark.createDataFrame([(i, int(f)) for i, f in enumerate(fp)], "node long, fp long")
    got = components(simhash.links(nodes, 3, cell))
    roots = {r["u"]: r["v"] for r in got.collect()}
    near = [(i, j) for i in range(len(fp)) for j in range(i) if (int(fp[i] ^ fp[j]) & (1 << 64) - 1).bit_count() <= 3]
    assert {i: roots.get(i, i) for i in range(len(fp))} == groups(near, range(len(fp)))


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)]
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for e in edges for x in e}
    assert {n: got.get(n, n) for n in nodes} == groups(edges, nodes)


@DATA
def test_near_groups(spark):
    more = odd(spark).where("doc_id is not null").selectExpr("doc_id + 10000 doc_id", "text")
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").unionByName(more).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    links = [(a, b) for a, x in fps for b, y in fps if b < a and (x ^ y).bit_count() <= 3]
    want = groups(links, [i for i, _ in rows])
    got = simhash.near_groups(docs).collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == sorted((i, f"{f:016x}", want[i]) for i, f in fps)


def test_near_copies_with_repeated_and_null_ids(spark):
    a, b = "one two three four five", "six seven eight nine ten"
    docs = spark.createDataFrame([(0, b), (1, a), (1, b), (None, "x y"), (None, "x y"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted(((r[0], r[1] or "") for r in simhash.deduplicated(docs).collect()), key=str)
    assert got == sorted([(0, b), (1, a), (None, "x y"), (2, "")], key=str)
    assert simhash.deduplicated(docs.limit(0)).count() == 0


def test_columns_of_the_table_come_back_as_they_were(spark):
    docs = spark.createDataFrame([(0, "a", "x", 1), (1, "a", "y", 2), (2, "b c", "z", 3)], "doc_id long, text string, sha string, kept int").withColumnRenamed("kept", "Kept")
    for how in (exact, simhash):
        assert sorted(map(tuple, how.deduplicated(docs).collect())) == [(0, "a", "x", 1), (2, "b c", "z", 3)]
