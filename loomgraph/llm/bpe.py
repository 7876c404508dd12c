"""BPE encoding by speculation: longest matches are proposed, adjacent pairs verified, failures merged exactly.

A cut of a word into tokens is its BPE encoding exactly if every token encodes to itself and every
adjacent pair encodes to itself: the first merge across a boundary would also be made within the
pair alone. Whether it would be made is found by undoing the merges next to the boundary, latest
first; numpy does that for all pairs of a batch at once.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers

from loomgraph.llm.common import pieces, texts

NEVER = 1 << 40
#: Words kept per Python worker; the memory is cleared when it is full and fills again.
REMEMBERED = 400_000
#: Letters, numbers and white space of three alphabets: the named properties cut down to ASCII and Latin-1.
CLASSES = {
    "ascii": {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r"\t-\r "},
    "latin": {r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ÿ", r"\p{N}": "0-9²³¹¼-¾", r"\s": "\\t-\\r \x85\xa0"},
}


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others follow from U+0100 on in byte order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@cache
def library_classes() -> dict[str, str]:
    """Letters, numbers and white space as the tokenizers library knows them (its Unicode version may differ)."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        points = [ord(c) for c in normalizers.Replace(Regex(f"[^{name}]"), "").normalize_str(every)]
        starts = [p for p, before in zip(points, [-2, *points]) if p != before + 1]
        ends = [p for p, after in zip(points, [*points[1:], -2]) if after != p + 1]
        found[name] = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends))
    return found


def alphabet(text: str) -> str:
    """The smallest of the three kinds of texts: ascii, latin (up to U+00FF) or all."""
    if text.isascii():
        return "ascii"
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return "all"
    return "latin"


class Splitter:
    """Parts a text into words by alternatives over letters {L}, numbers {N} and white space {S}."""

    def __init__(self, pattern: str):
        self.pattern = pattern
        self._by = {kind: re.compile(self._filled(c)).findall for kind, c in CLASSES.items()}

    def _filled(self, classes: dict[str, str]) -> str:
        return self.pattern.replace("{L}", classes[r"\p{L}"]).replace("{N}", classes[r"\p{N}"]).replace("{S}", classes[r"\s"])

    def __call__(self, text: str) -> list[str]:
        kind = alphabet(text)
        if kind not in self._by:
            self._by[kind] = regex.compile(self._filled(library_classes())).findall
        return self._by[kind](text)


#: The two patterns of the public files, with alternatives that can't start alike put in order of frequency.
WORDS = Splitter("[{L}]+|[{N}]|'(?:s|t|re|ve|m|ll|d)|[^{S}{L}{N}]+")
SPACED = Splitter(" ?[{L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+")


_LOWER = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


def lowered(text: str) -> str:
    """Composed and lower-cased letter by letter; beyond Latin-1, which has no case of doubt, by the library."""
    return text.lower() if alphabet(text) != "all" else _LOWER.normalize_str(text)


class Vocabulary:
    """A BPE vocabulary of the tokenizers file format; words are in byte letters."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text())
        model = spec["model"]
        if model.get("continuing_subword_prefix") or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("this kind of vocabulary is not supported")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError("only plain added tokens are supported")
        self.size = max([*self.ids.values(), *self.special.values()]) + 1
        self.text = [""] * self.size
        for t, i in [*self.ids.items(), *self.special.items()]:
            self.text[i] = t
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank, self.left, self.right = np.full(self.size, -1), np.full(self.size, -1), np.full(self.size, -1)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.merges[x, y] = r, z
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        keys = np.array([x * self.size + y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        made = np.flatnonzero(self.rank >= 0)
        # verification reads time off the ranks: a token's parts must be older than itself, and made one way
        self.orderly = len(made) == len(pairs) and bool((np.maximum(self.rank[self.left[made]], self.rank[self.right[made]]) < self.rank[made]).all())
        self.whole = np.ones(self.size, bool)
        if self.orderly:
            self.whole[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
            for t in made[np.argsort(self.rank[made])]:
                self.whole[t] &= self.whole[self.left[t]] and self.whole[self.right[t]]
        self._longest: dict[str, int] = {}
        for t in self.ids:
            body = t.removesuffix(self.suffix) if self.suffix else t
            self._longest[t[:2]] = max(self._longest.get(t[:2], 0), len(body))
            self._longest[t[:1]] = max(self._longest.get(t[:1], 0), 1)
        self._letters = dict(enumerate(byte_letters()))

    def letters(self, word: str) -> str:
        if word.isascii() and word.isprintable() and " " not in word:
            return word
        return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._letters)

    def _rank_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        keys = x * self.size + y
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | int = NEVER) -> np.ndarray:
        """True where no merge of rank below ``limit`` crosses from token a to token b.

        The tokens next to the boundary are undone, latest first. A pair that stood side by side
        until rank r would have merged if its own rank is below r; equal ranks go from left to right.
        """
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = np.asarray(a, np.int64).copy(), np.asarray(b, np.int64).copy()
        lim = np.broadcast_to(np.asarray(limit, np.int64), x.shape).copy()
        while len(at):
            clash = self._rank_of(x, y) < lim
            good[at[clash]] = False
            go = ~clash & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            at, x, y = at[go], x[go], y[go]
            first = self.rank[x] > self.rank[y]
            lim = np.where(first, self.rank[x], self.rank[y] + 1)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return good

    def propose(self, word: str) -> list[int] | None:
        """Longest matches from left to right; None if a letter isn't in the vocabulary."""
        ids, longest, suffix, n = self.ids, self._longest, self.suffix, len(word)
        out, i = [], 0
        while i < n:
            reach = longest.get(word[i : i + 2]) or longest.get(word[i], 0)
            if i + reach >= n:
                found = ids.get(word[i:] + suffix)
                if found is not None:
                    out.append(found)
                    return out
                reach = n - i - 1 if suffix else n - i
            for j in range(i + reach, i, -1):
                found = ids.get(word[i:j])
                if found is not None:
                    out.append(found)
                    i = j
                    break
            else:
                return None
        return out

    def merged(self, word: str) -> list[int]:
        """Exact merging: always the pair of lowest rank, the leftmost of equal ones."""
        symbols = [*word[:-1], word[-1:] + self.suffix] if word else []
        ids = [self.ids[s] for s in symbols if s in self.ids]  # unknown letters are left out, as the library does
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i] = self.merges[x, y][1]
            ids[j] = -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (m := self.merges.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, ids[p], ids[q]))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word (not empty)."""
        spelled = [self.letters(w) for w in words]
        if not self.orderly:
            return [self.merged(w) for w in spelled]
        out = [self.propose(w) for w in spelled]
        size = np.array([len(x) if x else 0 for x in out], np.int64)
        flat = np.fromiter((i for x in out if x for i in x), np.int64, int(size.sum()))
        of = np.repeat(np.arange(len(out)), size)
        bad = np.zeros(len(out), bool)
        bad[size == 0] = True
        bad[of[~self.whole[flat]]] = True
        if len(flat) > 1:
            inside = np.flatnonzero(of[1:] == of[:-1])
            pairs, back = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
            good = self.compatible(pairs // self.size, pairs % self.size)
            bad[of[inside[~good[back]]]] = True
        for i in np.flatnonzero(bad):
            out[i] = self.merged(spelled[i])
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def parted(text: str, special: dict[str, int]) -> Iterator[tuple[str, int | None]]:
    """Pieces of a text: (piece, None), or (special string, its id), which never merges with its neighbours."""
    if not any(s in text for s in special):
        yield text, None
        return
    for part in re.split("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")", text):
        if part:
            yield part, special.get(part)


class WordEncoder:
    """Encodes texts word by word and remembers words; ids come as little-endian 32-bit integers."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.known: dict[str | int, bytes] = {}

    def learn(self, words: Iterable[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(words)
        for w, ids in zip(new, self.vocabulary.encode_words(new)):
            self.known[w] = np.array(ids, "<u4").tobytes()

    def encode(self, batch: list[str]) -> list[bytes]:
        special = self.vocabulary.special
        lists, seen = [], set()
        for text in batch:
            found: list = []
            for part, mark in parted(text, special):
                if mark is None:
                    found += WORDS(lowered(part))
                else:
                    found.append(mark)
            lists.append(found)
            seen.update(found)
        self.learn({w for w in seen if isinstance(w, str)})
        self.known |= {i: np.array([i], "<u4").tobytes() for i in special.values()}
        return [b"".join(map(self.known.__getitem__, found)) for found in lists]

    def decode(self, ids: bytes) -> str:
        """Tokens joined by one space, as a file without a decoder asks for."""
        return " ".join(map(self.vocabulary.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encoded(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as little-endian 32-bit integers, and the text decoded from them.

    A null text counts as empty: no ids, an empty decoded text. Rows come out as they go in, repeats
    included; other columns are left aside. Words are cut at no length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part in pieces(batch, chars=1 << 20):
                ids = coder.encode(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(coder.decode, ids), pa.string())],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    source = texts(df, key, text)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, decoded string")
