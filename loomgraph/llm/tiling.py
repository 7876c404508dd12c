"""Benchmark decontamination by greedy string tiling.

Runs of ``tile`` words that a document shares with a benchmark item are found by rolling hashes
(Karp-Rabin) and joined into maximal matches; the longest match that is still free is marked again
and again. The share of an item's words under tiles catches passages whose parts were reordered.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import kept_rows, pieces, texts

_WORD = re.compile(r"\w+").findall
_BASE = np.uint64(0x100000001B3)
RESULT = "coverage double, item_ids array<long>"


def tokens(text: str) -> np.ndarray:
    """64-bit hashes of the lower-cased words."""
    words = _WORD(text.lower())
    coded = map(str.encode, words, repeat("utf-8"), repeat("surrogatepass"))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, coded), np.uint64, len(words))


def rolled(word: np.ndarray, tile: int) -> np.ndarray:
    """Hash of each run of ``tile`` words, modulo 2^64."""
    n = len(word) - tile + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(tile):
        h = h * _BASE + word[j : j + n]
    return h


def tiled(doc: np.ndarray, item: np.ndarray, tile: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Words of the item under tiles, and the tiles (place in doc, place in item, length).

    Longest first; of equal ones the first in the document, then in the item.
    """
    a, b = rolled(doc, tile), rolled(item, tile)
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    times = high - low
    i = np.repeat(np.arange(len(a)), times)
    if not len(i):
        return 0, []
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)]
    true = np.ones(len(i), bool)
    for k in range(tile):  # a hash is only a hint
        true &= doc[i + k] == item[j + k]
    i, j = i[true], j[true]
    by = np.lexsort((i, i - j))
    i, j = i[by], j[by]
    start = np.flatnonzero(np.r_[True, (np.diff(i - j) != 0) | (np.diff(i) != 1)]) if len(i) else np.empty(0, int)
    length = np.diff(np.r_[start, len(i)]) + tile - 1
    heap = [(-int(n), int(x), int(y)) for n, x, y in zip(length, i[start], j[start])]
    heapq.heapify(heap)
    in_doc, in_item, tiles = np.zeros(len(doc), bool), np.zeros(len(item), bool), []
    while heap:
        n, x, y = heapq.heappop(heap)
        taken = in_doc[x : x - n] | in_item[y : y - n]
        if not taken.any():
            in_doc[x : x - n] = in_item[y : y - n] = True
            tiles.append((x, y, -n))
            continue
        edges = np.flatnonzero(np.diff(np.r_[1, taken, 1]))
        for s, e in zip(edges[::2], edges[1::2]):  # what is still free of it
            if e - s >= tile:
                heapq.heappush(heap, (int(s - e), x + int(s), y + int(s)))
    return int(in_item.sum()), tiles


class Benchmark:
    """Items with an index of their seeds, for tasks that hold the whole benchmark."""

    def __init__(self, items: list[tuple[int, str]], tile: int):
        self.tile = tile
        self.ids = [i for i, _ in items]
        self.items = [tokens(t) for _, t in items]
        seeds = [rolled(t, tile) for t in self.items]
        flat = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        of = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        self.seed, self.of = flat[order], of[order]

    def covered(self, text: str, threshold: float) -> tuple[float, list[int]]:
        """The largest coverage of an item, and the ids of those covered to the threshold at least."""
        doc = tokens(text)
        h = rolled(doc, self.tile)
        if not len(h) or not len(self.seed):
            return 0.0, []
        at = np.minimum(np.searchsorted(self.seed, h), len(self.seed) - 1)
        hit = np.unique(h[self.seed[at] == h])
        best, found = 0.0, []
        if len(hit):
            low, high = np.searchsorted(self.seed, hit, "left"), np.searchsorted(self.seed, hit, "right")
            for k in np.unique(np.concatenate([self.of[a:b] for a, b in zip(low, high)])):
                share = tiled(doc, self.items[k], self.tile)[0] / len(self.items[k])
                best = max(best, share)
                if share >= threshold:
                    found.append(self.ids[k])
        return best, sorted(found)


def _usable(benchmark: DataFrame) -> DataFrame:
    return texts(benchmark, "item_id").withColumnRenamed("doc_id", "item_id").where("item_id is not null and text <> ''").distinct()


def _small(items: DataFrame, chars: int) -> bool:
    return (items.agg(F.sum(F.length("text") + 64)).first()[0] or 0) <= chars


def coverage(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, tile: int = 5, broadcast_chars: int = 1 << 25) -> DataFrame:
    """(doc_id, coverage, item_ids, kept) for every row of ``docs``.

    kept is false if an item is covered to ``threshold`` at least. Items of fewer than ``tile`` words
    hold no tile and cover nothing; null and empty texts neither. Rows that repeat an id each get
    their row; a repeated item counts once. A benchmark of up to ``broadcast_chars`` characters is
    broadcast (its size is measured); a larger one is joined by shared seeds.
    """
    items = _usable(benchmark)
    source = texts(docs)
    key = source.schema["doc_id"].dataType.simpleString()
    if _small(items, broadcast_chars):
        make = _broadcast(items, tile)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = make()
            for batch in batches:
                for part in pieces(batch):
                    found = [known.covered(t, threshold) for t in part["text"].to_pylist()]
                    yield pa.RecordBatch.from_arrays(
                        [part["doc_id"], pa.array([x for x, _ in found], pa.float64()), pa.array([x for _, x in found], pa.list_(pa.int64()))],
                        ["doc_id", "coverage", "item_ids"],
                    )

        out = source.mapInArrow(run, f"doc_id {key}, {RESULT}")
    else:
        out = _joined(source, items, threshold, tile)
    return out.withColumn("kept", F.col("coverage") < threshold)


def _broadcast(items: DataFrame, tile: int):
    rows = [(r["item_id"], r["text"]) for r in items.orderBy("item_id", "text").collect()]  # measured before
    sent = items.sparkSession.sparkContext.broadcast(rows)
    return lambda: Benchmark(sent.value, tile)


def _joined(source: DataFrame, items: DataFrame, threshold: float, tile: int, name: str = "doc_id") -> DataFrame:
    """The same for a benchmark of any size: pairs that share a seed, tiled one by one.

    Pairs carry ids only; texts join them afterwards. Documents are told apart by a hash of their
    text, so repeated ids and copies need no pairs of their own. ``name`` is what rows are named by: doc_id, or
    which (that hash).
    """
    named = source.withColumn("which", F.sha2("text", 256))

    def seeds(name: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch):
                    for which, text in zip(part[name].to_pylist(), part["text"].to_pylist()):
                        h = np.unique(rolled(tokens(text), tile)).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([which] * len(h), part[name].type), pa.array(h)], [name, "seed"])
        return run

    once = named.select("which", "text").dropDuplicates(["which"])
    left = once.mapInArrow(seeds("which"), "which string, seed long")
    right = items.mapInArrow(seeds("item_id"), "item_id long, seed long")
    pairs = left.join(right, "seed").select("which", "item_id").distinct()

    def tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = []
            for a, b in zip(batch["text"].to_pylist(), batch["item"].to_pylist()):
                item = tokens(b)
                share.append(tiled(tokens(a), item, tile)[0] / len(item))
            yield pa.RecordBatch.from_arrays([batch["which"], batch["item_id"], pa.array(share, pa.float64())], ["which", "item_id", "share"])

    shares = (
        pairs.join(items.select("item_id", F.col("text").alias("item")), "item_id").join(once, "which")
        .mapInArrow(tile_pairs, "which string, item_id long, share double")
    )
    best = shares.groupBy("which").agg(
        F.max("share").alias("coverage"),
        F.sort_array(F.collect_set(F.when(F.col("share") >= threshold, F.col("item_id")))).alias("item_ids"),
    )
    return named.join(best, "which", "left").select(
        name, F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, tile: int = 5, broadcast_chars: int = 1 << 25) -> DataFrame:
    """The rows of ``docs`` that cover no item, with all their columns. Each row is judged by its own text."""
    items = _usable(benchmark)
    if _small(items, broadcast_chars):
        make = _broadcast(items, tile)

        def keep():
            known = make()
            return lambda batch: [known.covered(t, threshold)[0] < threshold for t in batch]

        return kept_rows(docs, keep)
    source = docs.select(F.lit(None).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    leaks = _joined(source, items, threshold, tile, "which").where(F.col("coverage") >= threshold).select(F.col("which").alias("_out")).distinct()
    return docs.join(leaks, F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == leaks["_out"], "left_anti")
