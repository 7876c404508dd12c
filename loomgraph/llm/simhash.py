"""SimHash near-dedup by anchor-point covering.

Two 64-bit fingerprints that differ in at most three bits differ in at most one bit on one of their
halves. Thirty bits of a half are covered by pairs of codewords of the [15,11] Hamming code: 2^22
anchors, each point within one bit of an anchor on either 15-bit part (the covering radius). A
fingerprint goes to every anchor within covering radius plus threshold of a half: (1 + 1, 1) or
(1, 1 + 1) bits, 15 anchors at most. Of two linked fingerprints each therefore also reaches the
other's nearest anchor, and they meet there. Every meeting is compared on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import fresh, partitions, pieces, texts, words
from loomgraph.llm.components import components
from loomgraph.session import cut_lineage

SEED, PART, HALF = 42, 15, 32
_CHUNK = 1 << 16


def fingerprint(text: str, size: int = 3) -> int:
    """A bit is 1 if it is set in over half the hashes of the shingles; no words: zero."""
    found = words(text)
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate((len(w) + 1 for w in found)))
    starts = [0, *ends[:-1]]
    shingles = [joined[a : b - 1] for a, b in zip(starts, ends[size - 1 :])]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(shingles), _CHUNK):
        part = shingles[at : at + _CHUNK]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(shingles), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                fp = np.array([fingerprint(t, size) for t in part["text"].to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(fp)], ["doc_id", "fp"])

    source = texts(df, key, text)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


@cache
def _codewords() -> tuple[np.ndarray, np.ndarray]:
    """For each 15-bit value: its nearest codeword, and the (at most) seven others within two bits.

    The syndrome is the exclusive or of the places (1 to 15) of the bits that are set. It is zero for
    a codeword; else flipping that place gives the nearest one, and flipping two places whose
    exclusive or is the syndrome gives those at distance two. A value with none has its nearest again.
    """
    values = np.arange(1 << PART, dtype=np.int64)
    syndrome = np.zeros_like(values)
    for i in range(1, PART + 1):
        syndrome ^= np.where(values >> (i - 1) & 1, i, 0)
    near = values ^ np.where(syndrome > 0, np.int64(1) << np.maximum(syndrome - 1, 0), 0)
    far = np.repeat(near[:, None], 7, axis=1)
    for s in range(1, PART + 1):
        pairs = [(i, i ^ s) for i in range(1, PART + 1) if i < i ^ s]
        flips = np.array([1 << (i - 1) | 1 << (j - 1) for i, j in pairs], np.int64)
        rows = np.flatnonzero(syndrome == s)
        far[rows] = values[rows, None] ^ flips
    return near, far


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchor keys: each fingerprint at every anchor that it must be replicated to."""
    near, far = _codewords()
    rows, keys = [], []
    index = np.arange(len(fp))
    mask = (1 << PART) - 1
    for half in range(2):
        bits = fp.view(np.uint64) >> np.uint64(HALF * half)
        a, b = ((bits >> np.uint64(s) & np.uint64(mask)).astype(np.int64) for s in (0, PART))
        base = np.int64(half) << np.int64(2 * PART)
        here = [(index, near[a] << PART | near[b])]
        for i in range(7):
            for other, spread in ((far[a][:, i] << PART | near[b], far[a][:, i] != near[a]), (near[a] << PART | far[b][:, i], far[b][:, i] != near[b])):
                here.append((index[spread], other[spread]))
        for r, k in here:
            rows.append(r)
            keys.append(k | base)
    return np.concatenate(rows), np.concatenate(keys)


def _forest(fp: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, root) with i <> root: the smallest place that i reaches by links inside its group.

    Rows are sorted by group. Links are found offset by offset, so memory follows the rows, not
    the pairs; labels then fall to the smallest of each connected set.
    """
    n = len(fp)
    label = np.arange(n)
    left, right = [], []
    alive = np.arange(n - 1)
    step = 1
    size = 0
    while len(alive):
        alive = alive[alive + step < n]
        alive = alive[group[alive] == group[alive + step]]
        linked = alive[np.bitwise_count(fp[alive] ^ fp[alive + step]) <= distance]
        linked = linked[label[linked] != label[linked + step]]
        if len(linked):
            left.append(linked)
            right.append(linked + step)
            size += len(linked)
            np.minimum.at(label, linked + step, label[linked])
            if size > 4 * n:  # keep a spanning set only
                label = _settle(label, np.concatenate(left), np.concatenate(right))
                left, right, size = [np.flatnonzero(label != np.arange(n))], [], 0
                right.append(label[left[0]])
                size = len(left[0])
        step += 1
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    label = _settle(label, np.concatenate(left), np.concatenate(right))
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _settle(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(nodes: DataFrame, distance: int = 3, cell: int = 4096) -> DataFrame:
    """(u, v): links between rows of ``nodes`` (node long, fp long, fingerprints distinct) that span
    the same components as all pairs within ``distance`` (3 at most) differing bits.

    A task gives a spanning forest of each anchor's links, never all its pairs. An anchor with more
    than ``cell`` rows is split into pairs of slices of at most about that size, each a group of its
    own, so no group grows with the data.
    """
    if distance > 3:
        raise ValueError("the covering holds for up to three bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 13):
                part = batch.slice(at, 1 << 13)
                node, fp = (part[c].to_numpy() for c in ("node", "fp"))
                rows, keys = anchors(fp)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node[rows]), pa.array(fp[rows])], ["anchor", "node", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def out(key, cut, node, fp):
            group = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cut[1:] != cut[:-1])])
            of = np.repeat(np.arange(len(group)), np.diff(np.r_[group, len(key)]))
            u, v = _forest(fp.view(np.uint64), of, distance)
            return pa.RecordBatch.from_arrays([pa.array(node[u]), pa.array(node[v])], ["u", "v"])

        for batch in batches:
            now = [batch[c].to_numpy() for c in ("anchor", "cut", "node", "fp")]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                continue
            last = int(np.flatnonzero((now[0] == now[0][-1]) & (now[1] == now[1][-1]))[0])  # this group may go on
            held = [x[last:] for x in now]
            if last:
                yield out(*(x[:last] for x in now))
        if held is not None and len(held[0]):
            yield out(*held)

    rows = nodes.mapInArrow(spread, "anchor long, node long, fp long")
    heavy = cut_lineage(
        rows.groupBy("anchor").count().where(F.col("count") > cell)
        .select("anchor", F.ceil(2 * F.col("count") / cell).cast("int").alias("slices"))
    )
    mine = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    cells = F.when(F.col("slices").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1),
            lambda other: F.least(mine, other).cast("long") * F.col("slices") + F.greatest(mine, other),
        )
    )
    placed = rows.join(heavy, "anchor", "left").select("anchor", F.explode(cells).alias("cut"), "node", "fp")
    return (
        placed.repartition(partitions(nodes), "anchor", "cut").sortWithinPartitions("anchor", "cut", "node")
        .mapInArrow(compare, "u long, v long")
    )


def _grouped(df: DataFrame, text: str, key: str, size: int, distance: int) -> DataFrame:
    """(doc_id, fp, component_id, root) for every row; root is a fingerprint that names the component."""
    table = cut_lineage(fingerprints(df, text, key, size))
    nodes = cut_lineage(table.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    # nodes are named by their fingerprint; ids come back in the end
    roots = components(links(nodes.select(F.col("fp").alias("node"), "fp"), distance))
    joined = cut_lineage(nodes.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left")
                         .select("fp", "doc_id", F.coalesce("root", "fp").alias("root")))
    smallest = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return table.join(joined.join(smallest, "root").select("fp", "component_id", "root"), "fp")


def near_groups(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    component_id is the smallest id that is reached over fingerprints which differ in at most
    ``distance`` bits. Texts without words (null, empty, white space) have fingerprint zero, linked
    like any other. Rows that repeat an id count as documents of their own with equal ids; a null id
    gets the smallest other id of its component, or null. Equal fingerprints become one node first,
    so a group of exact copies costs one row. Long texts are read whole; other columns are left
    aside; an empty table gives an empty result.
    """
    return _grouped(df, text, key, size, distance).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
    )


def deduplicated(docs: DataFrame, size: int = 3, distance: int = 3) -> DataFrame:
    """One row of each group stays, with all its columns: one with the smallest id, or with a null id where no row of the
    group has another.

    Rows that repeat an id are told apart by their fingerprints; of rows with equal id and fingerprint one stays. An empty
    table gives an empty result; columns may have any names beside doc_id and text.
    """
    mine = cut_lineage(_grouped(docs, "text", "doc_id", size, distance))
    again = mine.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("again"), "rows")
    kept, own = fresh(docs, "kept"), fresh(docs, "fp")
    stay = (
        mine.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root").agg(F.first("doc_id").alias("id"), F.min("fp").alias("fp"))  # all rows of a root have one id here
        .join(again, F.col("id").eqNullSafe(F.col("again")), "left")
        .select(F.struct("id", "fp", F.col("rows").isNull().alias("lone")).alias(kept))
    )
    found = docs.join(stay, F.col("doc_id").eqNullSafe(F.col(f"{kept}.id")))
    rest = found.where(~F.col(f"{kept}.lone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                fp = np.array([fingerprint(t or "", size) for t in part["text"].to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fp)], [*part.schema.names, own])

    # only rows whose id repeats are looked at once more
    told = rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(own, T.LongType())]))
    one = told.where(F.col(own) == F.col(f"{kept}.fp")).dropDuplicates(["doc_id", own])
    return found.where(f"{kept}.lone").select(*docs.columns).unionByName(one.select(*docs.columns))
