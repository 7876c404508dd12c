"""Token ids as Re-Pair grammars: shards of documents whose frequent id pairs became rules.

A shard holds the ids of neighbouring documents (in doc_id order) as 16-bit symbols. Symbols from
``first_rule`` on are rules: rule r stands for the two symbols rules[2r], rules[2r + 1] and for
lengths[r] ids. Any run of ids is found by adding up lengths and expanding only the symbols that
cover it. No rule crosses a document's end, so documents are cut out by their symbol ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgraph.llm.bpe import SPACED, alphabet, parted
from loomgraph.llm.common import binaries, partitions, pieces, texts
from loomgraph.session import new_path

#: Words kept per Python worker; the memory is cleared when it is full and fills again. Longer words are not kept.
REMEMBERED = 1_000_000
LONGEST = 64
SHARD = (
    "part int, seq int, first_rule int, rules binary, lengths binary, symbols binary, "
    "doc_ids array<long>, symbol_ends array<long>, id_ends array<long>"
)


class LibraryEncoder:
    """Ids of texts by the tokenizers library, with each distinct word encoded once per worker.

    The pre-tokenizer parts a text into words that are encoded apart, so the ids of a text are those
    of its words in a row.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.known: dict[str | int, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]  # a letter a byte

    def learn(self, new: set[str]) -> None:
        plain = [w for w in new if (w.isascii() or alphabet(w) != "all") and w.lstrip(" ").isalpha()]
        rest = new.difference(plain)
        for k in range(0, len(plain), 1 << 14):
            self._together(plain[k : k + (1 << 14)])
        for w, coded in zip(rest, self.tokenizer.encode_batch_fast(list(rest), add_special_tokens=False)):
            self.known[w] = np.array(coded.ids, "<u4").tobytes()

    def _together(self, plain: list[str]) -> None:
        """Words of letters as one text, which is parted at their spaces, or at line feeds where they have none.

        Tokens know how many bytes they stand for, so their sums tell where each word ends.
        """
        parts = [x for w in plain for x in (("", w) if w[0] == " " else ("\n", w))]
        text = "".join(parts)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum(list(map(len, parts if text.isascii() else map(str.encode, parts))))
        cut = np.searchsorted(np.r_[0, np.cumsum(self.bytes[ids])], ends)
        coded, cut = ids.tobytes(), (4 * cut).tolist()
        for w, a, b in zip(plain, cut[::2], cut[1::2]):
            self.known[w] = coded[a:b]

    def encode(self, batch: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.known |= {i: np.array([i], "<u4").tobytes() for i in self.special.values()}
        lists, new = [], set()
        for text in batch:
            if any(s in text for s in self.special):
                found = [w for part, mark in parted(text, self.special) for w in (SPACED(part) if mark is None else [mark])]
            else:
                found = SPACED(text)
            new.update(filterfalse(self.known.__contains__, found))
            lists.append(found)
        self.learn(new)
        out = [b"".join(map(self.known.__getitem__, found)) for found in lists]
        for w in new:  # a memory of short words has a bound in bytes as well
            if len(w) > LONGEST:
                del self.known[w]
        return out


@cache
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _free(hits: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places where pairs start, sorted, those that overlap no earlier chosen one (every second of a run)."""
    start = np.r_[True, np.diff(hits) > 1]
    run = np.maximum.accumulate(np.where(start, np.arange(len(hits)), 0))
    free = (np.arange(len(hits)) - run) % 2 == 0
    return hits[free], what[free]


def compress(symbols: np.ndarray, ends: np.ndarray, first_rule: int, share: float = 0.6, least: int = 4):
    """(symbols, ends, rules, lengths) after replacing frequent pairs, round by round, until none inside a document occurs
    ``least`` times or the 16-bit numbers are used up (at most 65536 - first_rule rules; rules and ids share them).

    A round turns the most frequent pairs into rules, as many as ``share`` of the numbers left; where two of them overlap
    the left one is replaced. Pairs are counted through a table of hashed slots, which counts one pair a slot exactly; a
    pair that met a full slot is met again under the next round's hash, and rounds end only when a count of all pairs
    finds none.
    """
    rules: list[np.ndarray] = []
    made, turn = 0, 0
    seq = symbols.astype(np.uint32)
    while (room := 65536 - first_rule - made) > 0 and len(seq) > 1:
        key = seq[:-1] << np.uint32(16) | seq[1:]
        across = ends[(ends > 0) & (ends < len(seq))] - 1
        slot = (key * np.uint32(0x9E3779B1 + 2 * turn) >> np.uint32(12)).astype(np.int64)
        slot[across] = 1 << 20
        named = np.zeros((1 << 20) + 1, np.uint32)
        named[slot] = key
        good = named[slot] == key
        times = np.bincount(slot[good], minlength=(1 << 20) + 1)
        often = np.flatnonzero(times[:-1] >= least)
        if not len(often):
            if not (np.unique(np.delete(key, across), return_counts=True)[1] >= least).any():
                break
            turn += 1
            continue
        room = min(room, max(1024, int(share * room)))
        if len(often) > room:
            often = np.sort(often[np.argsort(-times[often], kind="stable")[:room]])
        index = np.full((1 << 20) + 1, -1, np.int32)
        index[often] = np.arange(len(often))
        number = index[slot]
        at = np.flatnonzero((number >= 0) & good)
        taken, number = _free(at, number[at])
        used = np.unique(number)  # a pair that only overlapped others makes no rule
        seq[taken] = (first_rule + made + np.searchsorted(used, number)).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[taken + 1] = False
        ends = ends - np.searchsorted(taken, ends - 1)
        seq = seq[keep]
        chosen = named[often[used]]
        rules.append(np.stack([chosen >> np.uint32(16), chosen & np.uint32(0xFFFF)], axis=1))
        made += len(chosen)
        turn += 1
    table = np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)
    lengths = np.ones(first_rule + made, np.int64)
    for r, (a, b) in enumerate(table.tolist()):
        lengths[first_rule + r] = lengths[a] + lengths[b]
    return seq.astype("<u2"), ends, table.astype("<u2"), lengths[first_rule:].astype("<u4")


class Shard:
    """Random access to the ids of one shard."""

    def __init__(self, first_rule: int, rules: bytes, lengths: bytes, symbols: bytes):
        self.first_rule, self.symbols = first_rule, np.frombuffer(symbols, "<u2")
        table, own = np.frombuffer(rules, "<u2").reshape(-1, 2), np.frombuffer(lengths, "<u4").astype(np.int64)
        self.length = np.r_[np.ones(first_rule, np.int64), own]
        self.begin = np.r_[np.arange(first_rule), first_rule + np.cumsum(own) - own]
        self.flat = np.empty(first_rule + int(own.sum()), np.uint32)
        self.flat[:first_rule] = np.arange(first_rule)
        for r, (a, b) in enumerate(table.tolist()):
            at = self.begin[first_rule + r]
            for part in (a, b):
                n = self.length[part]
                self.flat[at : at + n] = self.flat[self.begin[part] : self.begin[part] + n]
                at += n

    def ids(self, start: int, end: int) -> np.ndarray:
        """Expansion of the symbols start to end."""
        s = self.symbols[start:end]
        n = self.length[s]
        at = np.cumsum(n)
        if not len(s):
            return np.empty(0, "<u4")
        return self.flat[np.repeat(self.begin[s] - (at - n), n) + np.arange(at[-1])].astype("<u4")

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the shard; only the symbols that cover them are expanded."""
        at = np.r_[0, np.cumsum(self.length[self.symbols])]
        first = max(0, int(np.searchsorted(at, start, "right")) - 1)
        last = int(np.searchsorted(at, end, "left"))
        return self.ids(first, last)[start - at[first] : end - at[first]]


def write(df: DataFrame, path: str, tokenizer: str, end: int = 0, text: str = "text", key: str = "doc_id", shard_ids: int = 1 << 20) -> None:
    """Encode every text, append ``end``, and write shards in ascending doc_id order to ``path`` (Parquet rows of SHARD).

    Documents are dealt out by ranges of doc_id; a shard closes once it has ``shard_ids`` ids, so a task holds one
    shard and one document more at most. A null text counts as empty (its only id is ``end``); rows that repeat an
    id follow each other; rows without an id are left out, since they have no place in the order.
    """
    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)
    if vocabulary > 65536:
        raise ValueError("symbols are 16 bits wide")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        tail = np.array([end], "<u4").tobytes()
        held: list[tuple[int, bytes]] = []
        size, seq, part = 0, 0, 0

        def close():
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            id_ends = np.cumsum([len(x) // 4 for _, x in held])
            symbols, ends, rules, lengths = compress(ids, id_ends, vocabulary)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "first_rule": pa.array([vocabulary], pa.int32()),
                "rules": [rules.tobytes()], "lengths": [lengths.tobytes()], "symbols": [symbols.tobytes()],
                "doc_ids": pa.array([[d for d, _ in held]], pa.list_(pa.int64())), "symbol_ends": pa.array([ends], pa.list_(pa.int64())), "id_ends": pa.array([id_ends], pa.list_(pa.int64())),
            })

        for batch in batches:
            for piece in pieces(batch, chars=1 << 20):
                part = piece["part"][0].as_py()
                for doc, ids in zip(piece["doc_id"].to_pylist(), coder.encode(piece["text"].to_pylist())):
                    held.append((doc, ids + tail))
                    size += len(ids) // 4 + 1
                    if size >= shard_ids:
                        yield close()
                        held, size, seq = [], 0, seq + 1
        if held:
            yield close()

    source = texts(df, key, text).where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    dealt = source.repartitionByRange(partitions(df), "doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id())
    dealt.mapInArrow(run, SHARD).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; start counts the ids of all documents before it.

    Shards are placed by two levels of sums: over the shards of a range, and over the ranges.
    """
    shards = spark.read.schema(SHARD).parquet(path)
    sizes = shards.select("part", "seq", F.element_at("id_ends", -1).alias("n"))
    in_part = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    over_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range of doc_ids
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(over_parts), F.lit(0)).alias("before"))
    starts = sizes.select("part", "seq", F.coalesce(F.sum("n").over(in_part), F.lit(0)).alias("within")).join(parts, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["first_rule"], row["rules"], row["lengths"], row["symbols"])
                ids = shard.ids(0, len(shard.symbols))
                bounds = np.r_[0, row["id_ends"]].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(bounds[:-1] + row["start"]), pa.array(np.diff(bounds)), binaries(ids, bounds)],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return (
        shards.join(starts.select("part", "seq", (F.col("before") + F.col("within")).alias("start")), ["part", "seq"])
        .mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
    )


def stored(df: DataFrame, tokenizer: str, **how) -> DataFrame:
    """Write ``df`` to the shared folder and give what the files hold (see ``read``)."""
    path = new_path(df.sparkSession, "token-shards")
    write(df, path, tokenizer, **how)
    return read(df.sparkSession, path)
