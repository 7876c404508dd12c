"""Log-probabilities of texts by a weighted backoff automaton over smoothed n-gram counts.

Dirichlet smoothing, P(w | h) = (c(hw) + m P(w | h')) / (c(h) + m), makes a backoff model: where hw was seen, an arc from
state h carries log P(w | h); where it was not, P(w | h) is m / (c(h) + m) times P(w | h'), so one failure arc a state
carries that factor and leads to the state of h'. States are the histories that were seen; the root has an arc for every
word. A text is read once from left to right: the state is carried, arcs that are missing are made up for by failure arcs,
and the weights add up.

The counts grow with the corpus, so no task holds them whole. Documents are dealt into blocks of bounded size. A block
sends the n-grams it has, once each, with its own training counts; slots (ranges of their hashes) add them up and answer
each pack with what the other blocks have, in the order of its keys. With these totals a block builds the part of the
automaton that its texts can reach. Only packs that hold a key travel, so at the far end a pack is a row of one n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import fold, pieces, texts

#: The end of a text, which also stands before its first word; no word is a line feed.
END = b"\n"
#: Keys that one merge of a slot holds, about.
_MERGED = 1 << 22
#: Tokens that a text is read for before the next lane takes over.
_STRETCH = 256
PACKED = "block int, ids array<{}>, train array<boolean>, sizes array<int>, texts binary"
PACK = "slot int, block int, keys binary, counts binary"
ANSWER = "slot int, block int, others binary"


def packed(values: np.ndarray) -> bytes:
    """Integers by byte planes, so that what is alike in all of them takes no room."""
    wide = np.ascontiguousarray(values).astype("<u8").view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(wide.T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def _keys(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.uint64)


def _distinct(values: np.ndarray, kind: str | None = None) -> np.ndarray:
    """Sorted distinct values, by a sort (many times faster than a hash table of them)."""
    values = np.sort(values, kind=kind)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def tokens(batch: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers of all tokens, hash of each word, tokens of each text); every text ends with word 0, the end.

    Arrow's ASCII functions lower A-Z and split at the six ASCII white spaces only.
    """
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(batch)))
    found = split.flatten()
    real = pc.not_equal(found, "")
    text = pc.list_parent_indices(split).filter(real).to_numpy()
    coded = found.filter(real).dictionary_encode()
    flat = np.zeros(len(text) + len(batch), np.int64)
    flat[np.arange(len(text)) + text] = coded.indices.to_numpy() + 1
    names = [END, *coded.dictionary.cast(pa.binary()).to_pylist()]
    return flat, np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names)), np.bincount(text, minlength=len(batch)) + 1


def grams(flat: np.ndarray, size: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n: the key of the n-gram that ends at each token (of hashes), and whether the text has one there.

    The token before a text's first is the end mark. Keys have their lowest bit set for n = 1 only.
    """
    first = np.cumsum(size) - size
    place = np.arange(len(flat)) - np.repeat(first, size)
    run, out = flat, [(flat | np.uint64(1), np.ones(len(flat), bool))]
    for n in range(2, order + 1):
        before = np.r_[np.uint64(0), run[:-1]]
        if n == 2:
            before[first] = np.uint64(xxhash.xxh3_64_intdigest(END))
        run = before * np.uint64(0x9E3779B97F4A7C15) + flat
        run = (run ^ run >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
        out.append((run & ~np.uint64(1) | np.uint64(4), place >= n - 2))
    return out


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block with their texts compressed together, in half the bytes."""
    for batch in batches:
        for part in pieces(batch, chars=1 << 24):
            of = part["block"].to_numpy()
            by = np.argsort(of, kind="stable")
            cut = np.flatnonzero(np.diff(of[by], prepend=-1))
            ends = np.r_[cut, len(by)].astype(np.int32)
            rows = part.take(pa.array(by))
            text = rows["text"].cast(pa.binary())
            lists = (pa.ListArray.from_arrays(ends, c) for c in (rows["doc_id"], rows["train"], pc.binary_length(text)))
            packs = [zstandard.ZstdCompressor(level=6).compress(b"".join(text[a:b].to_pylist())) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(of[by][cut], pa.int32()), *lists, pa.array(packs, pa.binary())], ["block", "ids", "train", "sizes", "texts"])


def _opened(table: pa.Table) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Ids, training flags and texts of the packs of a block."""
    ids, train, sizes = (table[c].combine_chunks().flatten() for c in ("ids", "train", "sizes"))
    data = b"".join(zstandard.ZstdDecompressor().decompress(x) for x in table["texts"].to_pylist())
    ends = np.r_[0, np.cumsum(sizes.to_numpy(), dtype=np.int64)]
    text = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(ends), pa.py_buffer(data))
    return ids, train.to_numpy(zero_copy_only=False), text


def _packs_of(keys: np.ndarray, counts: np.ndarray, block: int, bits: int) -> list[pa.Array]:
    """Columns of PACK: sorted keys by slots, for each slot that has any."""
    slot = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.diff(slot, prepend=-1))
    ends = np.r_[cut[1:], len(slot)]
    return [
        pa.array(slot[cut], pa.int32()), pa.array(np.full(len(cut), block), pa.int32()),
        pa.array([packed(_steps(keys[a:b])) for a, b in zip(cut, ends)], pa.binary()),
        pa.array([packed(counts[a:b]) for a, b in zip(cut, ends)], pa.binary()),
    ]


def _learned(bits: int):
    """Packs of the words of training texts, once for each piece of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, chars=1 << 25):
                flat, hashes, _ = tokens(part["text"])
                n = np.bincount(flat, minlength=len(hashes))
                by = np.argsort(hashes)
                yield pa.RecordBatch.from_arrays(_packs_of(hashes[by], n[by], 0, bits), ["slot", "block", "keys", "counts"])

    return run


def _sums(table: pa.Table) -> pa.Table:
    """Distinct words of a slot, and how many tokens they are."""
    types = len(_distinct(np.concatenate([_keys(unpacked(x)) for x in table["keys"].to_pylist()])))
    n = sum(int(unpacked(x).sum()) for x in table["counts"].to_pylist())
    return pa.table({"types": pa.array([types], pa.int64()), "n": pa.array([n], pa.int64())})


@dataclass
class _Block:
    """Ids of the rows of a block, its n-grams by order and all their keys in order, with the block's own training counts."""

    ids: pa.Array
    flat: np.ndarray
    size: np.ndarray
    of: list[np.ndarray]  # for each n: the n-gram that ends at each token, or -1
    at: list[np.ndarray]  # for each n: where its n-grams stand in keys
    keys: np.ndarray
    own: np.ndarray


def _block(table: pa.Table, order: int) -> _Block:
    ids, train, text = _opened(table)
    flat, hashes, size = tokens(text)
    learns = np.repeat(train, size)
    of, found, counts = [], [], []
    for n, (key, ok) in enumerate(grams(hashes[flat], size, order)):
        if n:
            distinct, back = np.unique(key[ok], return_inverse=True)
        else:  # each word once is enough
            distinct, back = np.unique(hashes | np.uint64(1), return_inverse=True)
            back = back[flat]
        found.append(distinct)
        counts.append(np.bincount(back, weights=learns[ok], minlength=len(distinct)).astype(np.int64))
        mine = np.full(len(flat), -1, np.int32)
        mine[ok] = back
        of.append(mine)
    keys = _distinct(np.concatenate(found), "stable")  # which merges sorted runs
    at = [np.searchsorted(keys, k).astype(np.int32) for k in found]
    own = np.zeros(len(keys), np.int64)
    for place, n in zip(at, counts):
        own[place] += n
    return _Block(ids, flat, size, of, at, keys, own)


def _emit(order: int, bits: int):
    """Packs of a block's distinct n-grams, one for each slot that has any, in the order of slots."""

    def run(table: pa.Table) -> pa.Table:
        block = _block(table, order)
        return pa.table(_packs_of(block.keys, block.own, table["block"][0].as_py(), bits), ["slot", "block", "keys", "counts"])

    return run


def _merge(table: pa.Table) -> pa.Table:
    """For each pack of a slot: what the other packs count for its keys."""
    keys = [_keys(unpacked(x)) for x in table["keys"].to_pylist()]
    own = [unpacked(x).astype(np.int64) for x in table["counts"].to_pylist()]
    found = _distinct(np.concatenate(keys))
    at = [np.searchsorted(found, k).astype(np.int32) for k in keys]
    del keys
    total = np.zeros(len(found), np.int64)
    for place, n in zip(at, own):  # keys of a pack are distinct
        total[place] += n
    others = [packed(total[place] - n) for place, n in zip(at, own)]
    return pa.table({"slot": table["slot"], "block": table["block"], "others": pa.array(others, pa.binary())})


def _slots(names: np.ndarray, size: int) -> np.ndarray:
    """Hashed places in a table whose size is a power of two, at most 2^32."""
    return (names.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) & (size - 1)


@dataclass
class Automaton:
    """States are numbered from the root, 0. An arc is named by state * words + word; the root's arcs are by word.

    ``place`` has one arc for each hashed slot of names; arcs that found theirs taken are in ``rest``, sorted by name.
    """

    words: int
    arcs: np.ndarray
    place: np.ndarray
    rest: np.ndarray
    rest_names: np.ndarray
    weight: np.ndarray
    follow: np.ndarray
    root_weight: np.ndarray
    root_follow: np.ndarray
    fail: np.ndarray
    fail_weight: np.ndarray

    def find(self, names: np.ndarray) -> np.ndarray:
        """Numbers of the arcs of these names, or -1."""
        if not len(self.arcs):
            return np.full(len(names), -1)
        at = self.place[_slots(names, len(self.place))].astype(np.int64)
        other = np.flatnonzero((self.arcs[at] != names) & (at >= 0))
        at[other] = -1
        if len(self.rest) and len(other):
            names = names[other]
            near = self.rest[np.minimum(np.searchsorted(self.rest_names, names), len(self.rest) - 1)]
            at[other] = np.where(self.arcs[near] == names, near, -1)
        return at

    def read(self, states: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, weights) of states that each read one word; failure arcs are followed up to an arc for it."""
        follow, weight = np.empty_like(states), np.zeros(len(states))
        left, now = np.arange(len(states)), states
        while len(left):
            root = now == 0
            if root.any():
                here = left[root]
                follow[here] = self.root_follow[word[here]]
                weight[here] += self.root_weight[word[here]]
                left, now = left[~root], now[~root]
                if not len(left):
                    break
            at = self.find(now * self.words + word[left])
            hit = at >= 0
            follow[left[hit]] = self.follow[at[hit]]
            weight[left[hit]] += self.weight[at[hit]]
            left, now = left[~hit], now[~hit]
            weight[left] += self.fail_weight[now]
            now = self.fail[now]
        return follow, weight


def automaton(block: _Block, counts: list[np.ndarray], prior: float, scale: float) -> tuple[Automaton, np.ndarray]:
    """The states and arcs that the texts of a block can reach, from the total counts of its n-grams by order; and the counts of its words."""
    first = np.cumsum(block.size) - block.size
    vocabulary = int(block.flat.max()) + 1
    # the n-gram of order 1 of every word
    gram = np.zeros(vocabulary, np.int64)
    gram[block.flat] = block.of[0]
    total = counts[0]
    p = (total + 0.5) / scale
    root_p, root_count = p[gram], total[gram]
    made = 1
    fail, fail_weight = [np.zeros(1, np.int64)], [np.zeros(1)]
    arcs, weights, follows = [], [], []

    def states(total: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """Numbers of the n-grams that were seen; the others stand for the state of what is left without their first word."""
        nonlocal made
        seen = np.flatnonzero(total > 0)
        number = behind.copy()
        number[seen] = made + np.arange(len(seen))
        fail.append(behind[seen])
        fail_weight.append(np.log10(prior / (total[seen] + prior)))
        made += len(seen)
        return number

    longest = len(counts)
    of_state = states(total, np.zeros(len(total), np.int64)) if longest > 1 else np.zeros(len(total), np.int64)
    root_follow = of_state[gram]
    for n in range(1, longest):
        of, below, now = block.of[n], block.of[n - 1], counts[n]
        here = np.flatnonzero(of >= 0)
        before = below[here - 1]
        if n == 1:
            before[np.searchsorted(here, first)] = gram[0]
        head, tail, last = (np.zeros(len(now), np.int64) for _ in range(3))
        head[of[here]], tail[of[here]], last[of[here]] = before, below[here], block.flat[here]
        p = (now + prior * p[tail]) / (total[head] + prior)
        behind = of_state[tail]
        follow = states(now, behind) if n + 1 < longest else behind
        seen = now > 0
        arcs.append(of_state[head][seen] * vocabulary + last[seen])
        weights.append(np.log10(p[seen]))
        follows.append(follow[seen])
        of_state, total = follow, now
    names, number = np.concatenate([np.empty(0, np.int64), *arcs]), np.arange(sum(map(len, arcs)), dtype=np.int32)
    place = np.full(1 << (2 * len(names)).bit_length(), -1, np.int32)
    slot = _slots(names, len(place))
    place[slot] = number
    rest = np.flatnonzero(place[slot] != number)
    rest = rest[np.argsort(names[rest])]
    return Automaton(
        vocabulary, names, place, rest, names[rest], np.concatenate([np.empty(0), *weights]),
        np.concatenate([np.empty(0, np.int64), *follows]), np.log10(root_p), root_follow, np.concatenate(fail), np.concatenate(fail_weight),
    ), root_count


def traversed(machine: Automaton, flat: np.ndarray, size: np.ndarray, order: int, stretch: int = _STRETCH) -> np.ndarray:
    """Log-probability of each text, read from left to right with the state carried along.

    All texts are read in step. A long one is read in stretches: a state depends on the last order - 1 tokens only, so a
    lane that starts that many tokens early at the root, without adding up their weights, arrives at the same state.
    """
    lanes = -(-size // stretch)
    text = np.repeat(np.arange(len(size)), lanes)
    within = (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * stretch
    begin = np.repeat(np.cumsum(size) - size, lanes) + within
    length = np.minimum(stretch, np.repeat(size, lanes) - within)
    state = np.where(within == 0, machine.root_follow[0], 0)  # the end mark stands before the first word
    warm = np.flatnonzero(within > 0)
    for back in range(order - 1, 0, -1):
        state[warm], _ = machine.read(state[warm], flat[begin[warm] - back])
    by = np.argsort(-length, kind="stable")
    begin, length, state = begin[by], length[by], state[by]
    score = np.zeros(len(text))
    for step in range(int(length[0]) if len(length) else 0):
        active = int(np.searchsorted(-length, -step))  # lanes with more than ``step`` tokens
        state[:active], weight = machine.read(state[:active], flat[begin[:active] + step])
        score[:active] += weight
    return np.bincount(text[by], weights=score, minlength=len(size))


def _score(order: int, prior: float, train_tokens: int, types: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _block(left, order)
        answers = right.sort_by("slot")["others"].to_pylist()
        block.own += np.concatenate([unpacked(x).astype(np.int64) for x in answers])
        machine, known = automaton(block, [block.own[at] for at in block.at], prior, train_tokens + 0.5 * (types + 1))
        first = np.cumsum(block.size) - block.size
        return pa.table({
            "doc_id": block.ids, "n_tokens": pa.array(block.size),
            "n_known": pa.array(np.add.reduceat((known > 0).astype(np.int64)[block.flat], first)),
            "train_tokens": pa.array(np.full(len(first), train_tokens, np.int64)),
            "base_score": pa.array(np.add.reduceat(machine.root_weight[block.flat], first)),
            "score": pa.array(traversed(machine, block.flat, block.size, order)),
        })

    return run


def scored(docs: DataFrame, folds: int = 5, out: int = 1, order: int = 3, prior: float = 100.0, block_chars: int = 1 << 23) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Counts are learned from the rows whose fold is not ``out``. A null or empty text is its end mark
    alone (one token). Rows that repeat an id are learned and scored each; a null id is a training
    row. Without training rows all counts are zero and the base probability is one per token. An
    empty table gives an empty result; other columns are left aside; long texts are read whole (a
    block holds one text at least). Keys of n-grams are 64-bit hashes.
    """
    source = texts(docs)
    key = source.schema["doc_id"].dataType.simpleString()
    train = F.coalesce(fold(F.col("doc_id"), folds) != out, F.lit(True))
    chars = source.agg(F.sum(F.length("text"))).first()[0] or 0
    # a token, about six characters, stands for one n-gram of each order at most: this bounds the keys of a slot
    bits = max(1, int(order * chars // 6 // _MERGED).bit_length())
    learned = source.where(train).select("text").mapInArrow(_learned(bits), PACK).groupBy("slot").applyInArrow(_sums, "types long, n long")
    types, train_tokens = (int(x or 0) for x in learned.agg(F.sum("types"), F.sum("n")).first())
    blocks = int(1 + chars // block_chars)
    dealt = (
        source.select("doc_id", "text", train.alias("train"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))
        .mapInArrow(_packs, PACKED.format(key)).repartition(blocks, "block")
    )
    answers = dealt.groupBy("block").applyInArrow(_emit(order, bits), PACK).groupBy("slot").applyInArrow(_merge, ANSWER)
    result = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(order, prior, train_tokens, types), f"doc_id {key}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return result.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), folds) == out, F.lit(False)))
