"""Repeated substrings by merging Burrows-Wheeler transforms of shards.

Every start of a 200-byte string belongs to one anchor: the place of the least hashed 32-byte gram
among those inside the string. Equal strings have their anchor at the same distance, so only starts
whose anchors hold the same gram can be equal. The starts of one anchor, with the 199 bytes after
the last of them, are a segment; segments of one gram are a group. Equal segments are one segment
with a weight.

1. Blocks of documents send (gram, segment) digests to slots of grams. A slot answers what is
   single, what occurs twice as a whole, and which groups hold different segments.
2. For the latter each block is a shard: it sorts the suffixes of its segments once and sends their
   Burrows-Wheeler transform, cut by slot.
3. A slot merges the transforms of its shards. The interleave of their suffixes starts as one bucket
   per group and is refined by stepping back 25 bytes at a time through the transforms: suffixes stay
   in the order of the last round within a bucket of the bytes before them. After eight rounds
   suffixes are side by side in one bucket exactly when they share 200 bytes; smaller buckets give the
   common prefixes on the way, and a bucket of one suffix leaves the interleave, as nothing that it
   precedes can be repeated. No suffix is sorted again.
4. Blocks mark the repeated starts and take out the bytes that they cover.

Groups with more different segments than a slot may hold are dealt out again with every start as a
segment of its own, which needs no merge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomgraph.llm.common import partitions, texts
from loomgraph.session import cut_lineage

LENGTH, GRAM, STEP = 200, 32, 25
WINDOW = LENGTH - GRAM + 1  # starts that can share an anchor
BLOCK, SLOT = 1 << 22, 1 << 22  # bytes of text in a block, and for each slot
#: Different segments of one group that are merged in one task; a larger group is divided.
GROUP = 1 << 15
#: A gram with more than this share of all entries is found before the slots meet.
FREQUENT = 1 << 16
_CHUNK = 1 << 17
_MASK = (WINDOW + 7) // 8
SINGLE, TWICE, MERGE, SAMPLE, DIVIDE = range(5)
_U = np.uint64


def packed(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = BLOCK) -> DataFrame:
    """(block, ids, sizes, bytes, body): documents in blocks of about ``size`` bytes, packed; without a shuffle."""
    source = texts(df, key, text)
    kind = source.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 32, 0
        ids, found, held, shape = [], [], 0, None
        pack = zstandard.ZstdCompressor(level=3)

        def out() -> pa.RecordBatch:
            sizes = list(map(len, found))
            row = [[base + seq], [ids], [sizes], [sum(sizes)], [pack.compress(b"".join(found))]]
            types = [pa.int64(), pa.list_(shape), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], ["block", "ids", "sizes", "bytes", "body"])

        for batch in batches:
            shape = batch["doc_id"].type
            for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                body = t.encode("utf-8", "surrogatepass")
                if held and held + len(body) > size:
                    yield out()
                    ids, found, held, seq = [], [], 0, seq + 1
                ids.append(i)
                found.append(body)
                held += len(body)
        if ids:
            yield out()

    return source.mapInArrow(run, f"block long, ids array<{kind.simpleString()}>, sizes array<long>, bytes long, body binary")


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on, by doubling."""
    h = (data.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)
    k = 1
    while k < GRAM:
        h, rest = h[: len(h) - k] * _U(0xBF58476D1CE4E5B9), h[k:]
        h += rest
        h ^= h >> _U(31)
        k *= 2
    return h


def _anchors(data: np.ndarray, n: int) -> np.ndarray:
    """For each of the first n places the leftmost one of the WINDOW places from there on with the least hash."""
    out = np.empty(n, np.int32)
    for at in range(0, n, _CHUNK):
        count = min(_CHUNK, n - at)
        h = _grams(data[at : at + count + WINDOW + GRAM - 2])
        least = (h & ~_U((1 << 24) - 1)) | np.arange(len(h), dtype=_U)
        k = 1
        while 2 * k <= WINDOW:
            least = np.minimum(least[: len(least) - k], least[k:])
            k *= 2
        least = np.minimum(least[: len(least) - (WINDOW - k)], least[WINDOW - k :])
        out[at : at + count] = at + (least[:count] & _U((1 << 24) - 1)).astype(np.int32)
    return out


class Block:
    """The texts of one block end to end, their segments and the distinct (gram, segment) entries by slot."""

    def __init__(self, ids: list, sizes: list[int], body: bytes, slots: int):
        self.ids, self.slots = ids, slots
        self.raw = zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, sum(sizes)))
        self.ends = np.cumsum(np.array(sizes, np.int64))
        self.begins = self.ends - np.array(sizes, np.int64)
        self.n = len(self.raw)
        self.data = np.frombuffer(self.raw + bytes(LENGTH), np.uint8)
        long = self.ends - self.begins >= LENGTH
        edge = np.zeros(self.n + 1, np.int32)
        np.add.at(edge, self.begins[long], 1)
        np.add.at(edge, self.ends[long] - LENGTH + 1, -1)
        place = np.flatnonzero(np.cumsum(edge)[: self.n])  # starts of 200 bytes within one text
        owner = _anchors(self.data, self.n)[place] if len(place) else place
        cut = np.flatnonzero(np.r_[True, (np.diff(owner) != 0) | (np.diff(place) != 1)]) if len(place) else place
        last = np.r_[cut[1:], len(place)] - 1 if len(place) else place
        self.start, self.owned = place[cut], place[last] - place[cut] + 1
        gram = [xxhash.xxh3_64_intdigest(self.raw[a : a + GRAM]) for a in owner[cut].tolist()]
        whole = [xxhash.xxh3_64_intdigest(self.raw[a:b]) for a, b in zip(self.start.tolist(), (self.start + self.owned + LENGTH - 1).tolist())]
        self.entries = Entries(np.array(gram, _U), np.array(whole, _U), slots)

    def divided(self, at: np.ndarray) -> tuple[np.ndarray, Entries]:
        """(starts, entries) with every start of the given segments as a segment of its own."""
        size = self.owned[at]
        place = np.repeat(self.start[at], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        strings = [self.raw[p : p + LENGTH] for p in place.tolist()]
        gram = np.array([xxhash.xxh3_64_intdigest(s) for s in strings], _U)
        return place, Entries(gram, np.array([xxhash.xxh3_64_intdigest(s, 1) for s in strings], _U), self.slots)


class Entries:
    """Distinct (gram, segment) pairs by (slot, gram, segment): first place in the given order, whether met again."""

    def __init__(self, gram: np.ndarray, whole: np.ndarray, slots: int):
        slot = (gram % _U(slots)).astype(np.int64)
        order = np.lexsort((whole, gram, slot))
        g, w = gram[order], whole[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (w[1:] != w[:-1])] if len(g) else np.zeros(0, bool)
        self.first = order[new]
        self.of = np.empty(len(order), np.int64)  # entry of each pair
        self.of[order] = np.cumsum(new) - 1
        self.gram, self.whole, self.slot = gram[self.first], whole[self.first], slot[self.first]
        self.again = np.bincount(self.of, minlength=len(self.first)) > 1

    def cuts(self) -> Iterator[tuple[int, slice]]:
        """(slot, entries in it) for each slot with entries."""
        at = np.flatnonzero(np.r_[True, np.diff(self.slot) != 0]) if len(self.slot) else np.zeros(0, np.int64)
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(self.slot)]):
            yield int(self.slot[a]), slice(a, b)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names)


_ENTRY = ["slot", "block", "grams", "segments", "again"]
_ENTRY_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _sent(block: int, e: Entries) -> pa.RecordBatch | None:
    rows = [(s, block, e.gram[k].tobytes(), e.whole[k].tobytes(), e.again[k].tobytes()) for s, k in e.cuts()]
    return _batch(rows, _ENTRY, _ENTRY_TYPES) if rows else None


def entries(blocks: DataFrame, slots: int) -> DataFrame:
    """(slot, block, grams, segments, again): each block's entries, a row for each slot that it has some for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = _sent(row["block"], Block(row["ids"], row["sizes"], row["body"], slots).entries)
                if out:
                    yield out

    return blocks.mapInArrow(run, "slot long, block long, grams binary, segments binary, again binary")


def frequent(sent: DataFrame, least: int = GROUP, counters: int = FREQUENT) -> np.ndarray:
    """Grams with more than ``least`` entries and 1 / ``counters`` of all: fewer than ``counters`` of them.

    A row names the grams that have more than 1 / counters of its own entries; what it leaves out
    adds up to 1 / counters of all, so a gram with 2 / counters of all entries is never missed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grams in batch["grams"].to_pylist():
                g = np.frombuffer(grams, _U)
                cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
                n = np.diff(np.r_[cut, len(g)])
                keep = (n > 1) & (n > len(g) / counters)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[g[cut][keep].view(np.int64), 0]), pa.array(np.r_[n[keep], 0]), pa.array(np.r_[np.zeros(keep.sum(), np.int64), len(g)])],
                    ["gram", "n", "everything"],
                )

    sums = sent.select("grams").mapInArrow(run, "gram long, n long, everything long")
    total = sums.agg(F.sum("everything")).first()[0] or 0
    rows = sums.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > max(least, total // counters)).collect()  # fewer than ``counters``
    return np.sort(np.array([r["gram"] for r in rows], np.int64).view(_U))


def judged(sent: DataFrame, known: np.ndarray, limit: int = GROUP) -> DataFrame:
    """(block, slot, codes): for each entry of each block, one byte.

    SINGLE: the only one of its gram. TWICE: the segment occurs again, and so does each start in it.
    MERGE: single, but its group has other segments. SAMPLE: as TWICE, and this block sends it to the
    merge. DIVIDE: the group has more than ``limit`` segments (or is among the ``known`` frequent ones).
    """

    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for slot, block, grams, segments, again in zip(*(c.to_pylist() for c in batch.columns)):
                keep = ~np.isin(np.frombuffer(grams, _U), known)
                if keep.any():
                    rows.append((slot, block, *(np.frombuffer(x, t)[keep].tobytes() for x, t in ((grams, _U), (segments, _U), (again, bool)))))
            if rows:
                yield _batch(rows, _ENTRY, _ENTRY_TYPES)

    def answer(rows: list[tuple]) -> pa.RecordBatch:
        sizes = [len(r[2]) // 8 for r in rows]
        gram, whole = (np.frombuffer(b"".join(r[k] for r in rows), _U) for k in (2, 3))
        again = np.frombuffer(b"".join(r[4] for r in rows), bool)
        order = np.lexsort((np.arange(len(gram)), whole, gram))
        g, w = gram[order], whole[order]
        group = np.r_[True, g[1:] != g[:-1]]
        new = group | np.r_[True, w[1:] != w[:-1]]
        in_group, in_segment = np.cumsum(group) - 1, np.cumsum(new) - 1
        twice = (np.bincount(in_segment) > 1) | (np.bincount(in_segment, again[order]) > 0)
        kinds = np.bincount(in_group, new)[in_group]  # different segments of the group
        open_ = np.bincount(in_group, new & ~twice[in_segment])[in_group]
        code = np.where(twice[in_segment], TWICE, np.where(kinds > 1, MERGE, SINGLE))
        code[(code == TWICE) & new & (open_ > 0)] = SAMPLE
        code[kinds > limit] = DIVIDE
        out = np.empty(len(code), np.uint8)
        out[order] = code
        at = np.cumsum(sizes)
        return _batch([(r[1], r[0], out[b - s : b].tobytes()) for r, s, b in zip(rows, sizes, at)], ["block", "slot", "codes"], [pa.int64(), pa.int64(), pa.binary()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_rows(batches), lambda r: r[0]):
            yield answer(list(rows))

    some = sent.mapInArrow(light, sent.schema) if len(known) else sent
    return _by(some, "slot", "block").mapInArrow(run, "block long, slot long, codes binary")


def _by(df: DataFrame, key: str, *rest: str) -> DataFrame:
    return df.repartition(partitions(df), key).sortWithinPartitions(key, *rest)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _beside(blocks: DataFrame, *answers: DataFrame) -> DataFrame:
    """Each block's row, followed by the answers to it by (which answer, slot)."""
    none = lambda names: [F.lit(None).cast(blocks.schema[n].dataType).alias(n) for n in names]
    body = ["ids", "sizes", "body"]
    all_ = blocks.select("block", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("slot"), F.lit(None).cast("binary").alias("answer"), *body)
    for k, a in enumerate(answers, 1):
        all_ = all_.unionByName(a.select("block", F.lit(k).alias("rank"), "slot", F.col(a.columns[-1]).alias("answer"), *none(body)))
    return _by(all_, "block", "rank", "slot")


def _each(batches: Iterator[pa.RecordBatch], slots: int, answers: int) -> Iterator[tuple]:
    """(block, Block, what each answer said of it, its slots in order)."""
    for block, rows in groupby(_rows(batches), lambda r: r[0]):
        first = next(rows)
        said: list[list[bytes]] = [[] for _ in range(answers)]
        for r in rows:
            said[r[1] - 1].append(r[3])
        yield block, Block(first[4], first[5], first[6], slots), [np.frombuffer(b"".join(x), np.uint8) for x in said]


def _codes(e: Entries, said: np.ndarray, known: np.ndarray) -> np.ndarray:
    """A code for every entry: frequent grams were not asked for."""
    out = np.full(len(e.gram), DIVIDE, np.uint8)
    out[~np.isin(e.gram, known)] = said
    return out


def transform(text: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Burrows-Wheeler transform of strings laid end to end: their suffixes by (group, suffix, string).

    Bytes are raised by one, 0 ends a string (UTF-8 has no byte over 0xF4). A string of n bytes has
    n + 1 rows. ``group`` never falls from string to string.
    """
    full = sizes + 1
    stop = np.cumsum(full) - 1
    t = np.zeros(int(full.sum()) + 8, np.uint64)
    inside = np.ones(len(t) - 8, bool)
    inside[stop] = False
    t[:-8][inside] = text.astype(np.uint64) + _U(1)
    n = len(inside)
    key = np.repeat(group.astype(np.uint64), full)
    live = np.ones(n, bool)
    for k in range(5):
        key = key << _U(9) | np.where(live, t[k : k + n], _U(0))
        live &= t[k : k + n] > 0
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    new = np.r_[True, (sorted_[1:] != sorted_[:-1])] | ~live[order]  # the ends of strings are told apart by their order
    rank = np.empty(n, np.int64)
    step = 5
    while True:
        heads = np.flatnonzero(new)
        rank[order] = np.repeat(heads, np.diff(np.r_[heads, n]))
        tied = np.flatnonzero(~new | np.r_[~new[1:], False])
        if not len(tied):
            return t[order - 1].astype(np.uint8)
        p = order[tied]
        pair = rank[p] << 32 | rank[p + step]
        by = np.argsort(pair, kind="stable")
        order[tied] = p[by]
        new[tied] = np.r_[True, pair[by][1:] != pair[by][:-1]]
        step *= 2


_SHARD = "slot long, block long, grams binary, owned binary, wanted binary, rows binary"


def shards(blocks: DataFrame, codes: DataFrame, known: np.ndarray, slots: int) -> DataFrame:
    """(slot, block, grams, owned, wanted, rows): the transform of each block's segments that are to be merged, cut by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
        names = ["slot", "block", "grams", "owned", "wanted", "rows"]
        for block, b, (said,) in _each(batches, slots, 1):
            e = b.entries
            code = _codes(e, said, known)
            sent = np.flatnonzero((code == MERGE) | (code == SAMPLE))
            if not len(sent):
                continue
            group = np.cumsum(np.r_[False, (np.diff(e.gram[sent]) != 0)])
            at = e.first[sent]
            begin, size = b.start[at], b.owned[at] + LENGTH - 1
            cut = np.flatnonzero(np.r_[True, np.diff(e.slot[sent]) != 0])
            # slots in runs of bounded size, each sorted once
            weight, run_of, held = np.add.reduceat(size, cut), [], 0
            for w in weight.tolist():
                held += w
                run_of.append(held // BLOCK)
            ends = [*cut[1:].tolist(), len(sent)]
            for _, part in groupby(range(len(cut)), lambda k: run_of[k]):
                ks = list(part)
                a, z = int(cut[ks[0]]), ends[ks[-1]]
                text = np.frombuffer(b"".join(b.raw[x : x + y] for x, y in zip(begin[a:z].tolist(), size[a:z].tolist())), np.uint8)
                rows = transform(text, size[a:z], group[a:z] - group[a])
                to = np.r_[0, np.cumsum(size[a:z] + 1)]
                out = []
                for k in ks:
                    s, f = int(cut[k]), ends[k]
                    out.append((
                        int(e.slot[sent[s]]), block, e.gram[sent[s:f]].tobytes(), b.owned[at[s:f]].astype(np.uint16).tobytes(),
                        (code[sent[s:f]] == MERGE).tobytes(), rows[to[s - a] : to[f - a]].tobytes(),
                    ))
                yield _batch(out, names, types)

    return _beside(blocks, codes).mapInArrow(run, _SHARD)


#: A fixed odd multiplier of the rolling names, and one random number per byte.
_ODD = 0xD6E8FEB86659FD93
_LETTERS = np.random.default_rng(1).integers(1, 1 << 63, 257, dtype=np.uint64)


def _back(rows: np.ndarray, part: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one byte back, STEP bytes back, name of those bytes) for each row of the transforms; the row count where a string starts.

    ``part`` numbers the (shard, group) of each row and ``strings`` counts the strings of each part.
    """
    n = len(rows)
    letter = (rows.astype(np.int64) - 1) & 255  # ends come last
    by = np.sort(part << 40 | letter << 32 | np.arange(n))
    one = np.full(n + 1, n, np.int32)
    at = by & 0xFFFFFFFF
    to = np.arange(n) + strings[part]
    keep = rows[at] > 0
    one[at[keep]] = to[keep]
    name = np.r_[_LETTERS[rows.astype(np.int64)], _U(0)]
    backs, names, length = {1: one}, {1: name}, 1
    while 2 * length <= STEP:
        p, h = backs[length], names[length]
        backs[2 * length], names[2 * length] = p[p], h + _U(pow(_ODD, length, 1 << 64)) * h[p]
        length *= 2
    done, p, h = 0, None, None
    for k in sorted(backs, reverse=True):
        if done + k <= STEP:
            p, h = (backs[k], names[k]) if p is None else (backs[k][p], h + _U(pow(_ODD, done, 1 << 64)) * names[k][p])
            done += k
    return one, p, h


def interleaved(rows: np.ndarray, part: np.ndarray, strings: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(repeated, one byte back, STEP bytes back) for the rows of all shards of a slot.

    ``group`` is the group of each part. A row is repeated when its suffix shares LENGTH bytes with
    that of another row of the group, of whatever shard.
    """
    n = len(rows)
    one, back, name = _back(rows, part, strings)
    of = group[part].astype(np.int32)
    mixed = (name[:n] ^ (name[:n] >> _U(29))) * _U(0xBF58476D1CE4E5B9) + of.astype(_U) * _U(0x9E3779B97F4A7C15)
    order = np.argsort(mixed)
    symbol = np.empty(n, np.int32)
    symbol[order] = np.cumsum(np.r_[False, np.diff(mixed[order]) != 0]) if n else 0
    z, bucket = np.arange(n, dtype=np.int32), of
    for _ in range(LENGTH // STEP):
        far = back[z] < n
        z, bucket = z[far], bucket[far]
        if not len(z):
            break
        by = np.sort(symbol[z].astype(np.int64) << 32 | np.arange(len(z)))
        perm = by & 0xFFFFFFFF
        s, old = by >> 32, bucket[perm]
        new = np.r_[True, (s[1:] != s[:-1]) | (old[1:] != old[:-1])]
        bucket = np.cumsum(new, dtype=np.int32) - 1
        stay = np.bincount(bucket)[bucket] > 1
        z, bucket = back[z[perm]][stay], bucket[stay]
    repeated = np.zeros(n + 1, bool)
    repeated[z] = True
    return repeated, one, back


def marks(sent: list[tuple]) -> list[tuple]:
    """(block, slot, masks) for the shards of one slot: for each wanted segment, a bit for each repeated start."""
    counts = [len(r[2]) // 8 for r in sent]
    gram = np.frombuffer(b"".join(r[2] for r in sent), _U)
    owned = np.frombuffer(b"".join(r[3] for r in sent), np.uint16).astype(np.int64)
    wanted = np.frombuffer(b"".join(r[4] for r in sent), bool)
    rows = np.frombuffer(b"".join(r[5] for r in sent), np.uint8)
    shard = np.repeat(np.arange(len(sent)), counts)
    head = np.r_[True, (gram[1:] != gram[:-1]) | (shard[1:] != shard[:-1])]
    part = np.cumsum(head) - 1
    _, group = np.unique(gram[head], return_inverse=True)
    strings = np.bincount(part)
    size = owned + LENGTH  # rows of a string
    repeated, one, back = interleaved(rows, np.repeat(part, size), strings, group)
    first = np.r_[0, np.cumsum(np.bincount(part, size).astype(np.int64))][:-1]
    at = np.flatnonzero(wanted)
    row = first[part[at]] + at - np.flatnonzero(head)[part[at]]  # the ends of strings come first in a part
    for _ in range(LENGTH // STEP):
        row = back[row]
    bits = np.zeros((len(at), 8 * _MASK), bool)
    left = owned[at] - 1
    live = np.arange(len(at))
    while len(live):
        bits[live, left[live]] = repeated[row[live]]
        row[live] = one[row[live]]
        left[live] -= 1
        live = live[left[live] >= 0]
    masks = np.packbits(bits, axis=1, bitorder="little")
    ends = np.r_[0, np.cumsum(np.add.reduceat(wanted.astype(np.int64), np.r_[0, np.cumsum(counts)[:-1]]))]
    return [(r[1], r[0], masks[a:b].tobytes()) for r, a, b in zip(sent, ends, ends[1:]) if b > a]


def merged(sent: DataFrame) -> DataFrame:
    """(block, slot, masks): the shards of every slot merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_rows(batches), lambda r: r[0]):
            out = marks(list(rows))
            if out:
                yield _batch(out, ["block", "slot", "masks"], [pa.int64(), pa.int64(), pa.binary()])

    return _by(sent, "slot", "block").mapInArrow(run, "block long, slot long, masks binary")


def _split(blocks: DataFrame, codes: DataFrame, known: np.ndarray, slots: int) -> DataFrame:
    """Entries of the groups that are divided: every start for itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, b, (said,) in _each(batches, slots, 1):
            at = np.flatnonzero(_codes(b.entries, said, known)[b.entries.of] == DIVIDE)
            out = _sent(block, b.divided(at)[1]) if len(at) else None
            if out:
                yield out

    return _beside(blocks, codes).mapInArrow(run, "slot long, block long, grams binary, segments binary, again binary")


def _starts(b: Block, known: np.ndarray, codes: np.ndarray, masks: np.ndarray, divided: np.ndarray) -> np.ndarray:
    """A boolean for every byte of the block: a repeated string starts here."""
    code = _codes(b.entries, codes, known)
    flag = np.zeros(b.n + 1, np.int32)
    mine = code[b.entries.of]
    whole = (mine == TWICE) | (mine == SAMPLE)
    np.add.at(flag, b.start[whole], 1)
    np.add.at(flag, b.start[whole] + b.owned[whole], -1)
    start = np.cumsum(flag)[: b.n] > 0
    merge = np.flatnonzero(code == MERGE)  # each met once in the block
    if len(merge):
        bits = np.unpackbits(masks.reshape(-1, _MASK), axis=1, bitorder="little")
        row, offset = np.nonzero(bits)
        start[b.start[b.entries.first[merge]][row] + offset] = True
    at = np.flatnonzero(mine == DIVIDE)
    if len(at):
        place, e = b.divided(at)
        start[place[np.isin(divided[e.of], (TWICE, SAMPLE))]] = True
    return start


_RESULT = "n_bytes long, n_removed long, n_spans long, kept binary"


def cleaned(df: DataFrame, text: str = "text", key: str = "doc_id", limit: int = GROUP, block: int = BLOCK, slot: int = SLOT, body: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256) for every row.

    Bytes of the UTF-8 text that lie in a 200-byte string which also starts elsewhere, in whatever
    document, are removed; ``kept`` is the rest (left null unless ``body``). A null text counts as empty.
    Texts under 200 bytes keep all. Rows that repeat a text lose all of it if it has 200 bytes, each
    of them. Null and repeated ids are rows like others; an empty table gives an empty result. Other
    columns are not read. A task holds one block (a longer text is a block of its own, at about 30
    bytes of memory a byte), or one slot's entries or shards. Segments are compared by 64-bit digests
    within a gram of 64 bits, and names of 25 bytes by 64 bits within a group.
    """
    blocks = cut_lineage(packed(df, text, key, block))
    slots = max(1, (blocks.agg(F.sum("bytes")).first()[0] or 0) // slot)
    sent = cut_lineage(entries(blocks, slots))
    known = frequent(sent, limit)
    codes = cut_lineage(judged(sent, known, limit))
    masks = cut_lineage(merged(shards(blocks, codes, known, slots)))
    parted = codes.select("block", "slot", "codes").limit(0)
    if len(known) or codes.select(F.max(F.instr(F.hex("codes"), f"{DIVIDE:02X}"))).first()[0]:
        parted = cut_lineage(judged(_split(blocks, codes, known, slots), known[:0], 1 << 62))
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b, (said, merge, apart) in _each(batches, slots, 3):
            total = np.r_[0, np.cumsum(_starts(b, known, said, merge, apart))]
            place = np.arange(b.n)
            gone = total[place + 1] > total[np.maximum(place - LENGTH + 1, 0)]
            rise = gone & ~np.r_[False, gone[:-1]] if b.n else gone
            rise[b.begins[b.begins < b.n]] = gone[b.begins[b.begins < b.n]]
            lost, spans = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(rise)]
            left = b.data[: b.n][~gone].tobytes()
            to = np.arange(b.n + 1) - lost
            out = []
            for i, a, z in zip(b.ids, b.begins.tolist(), b.ends.tolist()):
                kept = left[to[a] : to[z]]
                out.append((i, z - a, int(lost[z] - lost[a]), int(spans[z] - spans[a]), kept if body else None, hashlib.sha256(kept).hexdigest()))
            types = [ids, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield _batch(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"], types)

    ids = to_arrow_type(blocks.schema["ids"].dataType.elementType)
    return _beside(blocks, codes, masks, parted).mapInArrow(run, f"doc_id {kind}, {_RESULT}, kept_sha256 string")
