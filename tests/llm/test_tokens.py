"""Encoders against the tokenizers library, and the grammar store against its input."""

import random
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomgraph.llm import bpe, repair

from .helpers import FOLDER, HAVE, ODD

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def samples():
    rng = random.Random(1)
    letters = ["the", "ing", "ß", " ", "  ", "\n", "'s", "'LL", "1", "²", "中", "😀", "\x00", "\x85", "\xa0", "​", "İ", "Σ", "<|endoftext|>", "<|startoftext|>", "<|", "é", "é", "-", "a" * 40]
    out = ["".join(rng.choices(letters, k=rng.randrange(30))) for _ in range(400)]
    return out + [t or "" for _, t in ODD] + ["a" + chr(c) + "b1" + chr(c) + " " + chr(c) for c in range(0x2000)]


def ids(coded):
    return np.frombuffer(coded, "<u4").tolist()


def test_speculation_equals_the_library():
    library, coder = Tokenizer.from_file(WORD), bpe.encoder(WORD)
    found = samples()
    got = coder.encode(found)
    for text, a, b in zip(found, library.encode_batch(found, add_special_tokens=False), got):
        assert a.ids == ids(b), text
        assert library.decode(a.ids, skip_special_tokens=False) == coder.decode(b)


def test_proposals_are_checked():
    v = bpe.vocabulary(WORD)
    rng = random.Random(2)
    words = ["".join(rng.choices("thereinganodsl", k=rng.randrange(1, 14))) for _ in range(3000)]
    exact = [v.merged(w) for w in words]
    wrong = sum(v.propose(w) != e for w, e in zip(words, exact))
    assert 0 < wrong < len(words)  # both branches are taken
    assert v.encode_words(words) == exact


def test_library_encoder():
    library, found = Tokenizer.from_file(BYTE), samples()
    for text, a, b in zip(found, library.encode_batch(found, add_special_tokens=False), repair.encoder(BYTE).encode(found)):
        assert a.ids == ids(b), text


def test_grammar_round_trip():
    rng = np.random.default_rng(3)
    for size, values in ((0, 5), (1, 5), (2, 1), (5000, 1), (5000, 3), (20_000, 300)):
        seq = rng.integers(0, values, size).astype("<u4")
        ends = np.unique(np.r_[rng.integers(0, size + 1, 9), size])
        symbols, symbol_ends, rules, lengths = repair.compress(seq, ends, 300, least=4)
        shard = repair.Shard(300, rules.tobytes(), lengths.tobytes(), symbols.tobytes())
        assert (shard.ids(0, len(symbols)) == seq).all()
        for (a, b), (x, y) in zip(zip(np.r_[0, symbol_ends], symbol_ends), zip(np.r_[0, ends], ends)):
            assert (shard.ids(a, b) == seq[x:y]).all()
        for a in range(0, size, 701):
            assert (shard.slice(a, min(size, a + 37)) == seq[a : a + 37]).all()
        assert size < 100 or len(symbols) < size


@pytest.mark.skipif(not HAVE, reason="driver tables are missing")
def test_stored_shards(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(5)
    library = Tokenizer.from_file(BYTE)
    got = sorted(map(tuple, repair.stored(docs, BYTE, shard_ids=3000).collect()))
    start = 0
    for (doc, at, n, coded), row in zip(got, sorted(docs.collect(), key=lambda r: r["doc_id"])):
        want = library.encode(row["text"], add_special_tokens=False).ids + [0]
        assert (doc, at, n, ids(coded)) == (row["doc_id"], start, len(want), want)
        assert crc32(coded) == crc32(np.array(want, "<u4").tobytes())
        start += n


@pytest.mark.skipif(not HAVE, reason="driver tables are missing")
def test_encoded(spark):
    docs, library = spark.read.parquet(f"{FOLDER}/documents.parquet"), Tokenizer.from_file(WORD)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in bpe.encoded(docs, WORD).collect():
        want = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert ids(r["ids"]) == want and r["n_tokens"] == len(want) and r["decoded"] == library.decode(want, skip_special_tokens=False)


def test_pairs_are_replaced_until_none_is_frequent():
    rng = np.random.default_rng(3)
    for ids, ends in [
        (np.full(100_000, 7, "<u4"), [100_000]),
        (rng.integers(0, 12, 4000).astype("<u4"), [0, 1, 1, 700, 2000, 4000]),
        (np.tile(np.arange(50, dtype="<u4"), 30), [1500]),
        (np.zeros(0, "<u4"), [0]),
    ]:
        symbols, cut, rules, lengths = repair.compress(ids, np.array(ends), 100)
        shard = repair.Shard(100, rules.tobytes(), lengths.tobytes(), symbols.tobytes())
        bounds = np.r_[0, cut]
        for i, (a, b) in enumerate(zip([0, *ends], ends)):
            assert np.array_equal(shard.ids(bounds[i], bounds[i + 1]), ids[a:b])
        pairs = [tuple(symbols[x : x + 2]) for a, b in zip(bounds, cut) for x in range(a, b - 1)]
        assert all(n < 4 or p[0] == p[1] for p, n in Counter(pairs).items())
    assert len(repair.compress(np.full(100_000, 7, "<u4"), np.array([100_000]), 100)[0]) < 40


def test_long_words_are_not_remembered():
    coder = repair.LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a" * 5000 + " b", "plain words", "<|endoftext|> x", ""]
    for _ in range(2):
        for got, text in zip(coder.encode(texts), texts):
            assert np.frombuffer(got, "<u4").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
    assert max(len(w) for w in coder.known if isinstance(w, str)) <= repair.LONGEST
