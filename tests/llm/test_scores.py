"""Classifiers by held-out accuracy, language model and tiling against plain versions."""

import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import language_model, quality, tiling, toxicity

from .helpers import FOLDER, HAVE, ODD, held_out, odd, words

MIDDLE = "/root/testdata/sf0.01"
needs = pytest.mark.skipif(not (HAVE and os.path.isdir(MIDDLE)), reason="driver tables are missing")


def area(scores, truth):
    pairs = [(a > b) + 0.5 * (a == b) for a, y in zip(scores, truth) if y for b, z in zip(scores, truth) if not z]
    return sum(pairs) / len(pairs)


@needs
@pytest.mark.parametrize("op, label, folds, out, least", [(quality, "quality", 4, 2, 0.93), (toxicity, "toxic", 5, 0, 0.8)])
def test_held_out_accuracy(spark, op, label, folds, out, least):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    rows = op.scored(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == held_out(r["doc_id"], folds, out) and 0 <= r["score"] <= 1 for r in rows)
    rows = [r for r in rows if r["held_out"]]
    assert area([r["score"] for r in rows], [r[label] for r in rows]) > least


@needs
def test_held_out_labels_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    few = quality.Settings(sample=200)
    own = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end quality")
    a, b = (sorted(map(tuple, quality.scored(docs, x, settings=few).collect())) for x in (labels, own))
    assert a == b


def plain_scores(rows, order, prior):
    end = b"\n"
    counts = Counter()
    for key, text in rows:
        if not held_out(key, 5, 1):
            s = [end, *words(text), end]
            counts.update(tuple(s[max(0, i - n + 1) : i + 1]) for i in range(1, len(s)) for n in range(1, order + 1) if i - n + 1 >= 0)
    single = {k: c for k, c in counts.items() if len(k) == 1}
    total, types = sum(single.values()), len(single)
    scale = total + 0.5 * (types + 1)
    for key, text in rows:
        s = [end, *words(text), end]
        base = score = 0.0
        for i in range(1, len(s)):
            p = (counts[s[i],] + 0.5) / scale
            base += math.log10(p)
            for n in range(2, order + 1):
                if i - n + 1 >= 0:
                    state = tuple(s[i - n + 1 : i])
                    p = (counts[(*state, s[i])] + prior * p) / (counts[state] + prior)
            score += math.log10(p)
        yield key, held_out(key, 5, 1), len(s) - 1, sum(counts[w,] > 0 for w in s[1:]), total, base, score


@needs
@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model(spark, order):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").unionByName(odd(spark).selectExpr("doc_id + 100000 doc_id", "text"))
    rows = [(r[0], r[1]) for r in docs.collect()]
    got = language_model.scored(docs, order=order, prior=50.0, block_chars=60_000).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    ).collect()
    key = lambda r: (r[0] or 0, r[2], r[6])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(plain_scores(rows, order, 50.0), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_probabilities_add_up():
    rows = [(i, t) for i, t in enumerate(["a b a", "b a b b", "a c"])]
    types = {w for _, t in rows for w in t.encode().split()} | {b"\n"}
    # every continuation of "a": known words, the end, and one unknown word
    total = 0.0
    for w in [*types, b"unknown"]:
        text = "a" if w == b"\n" else "a " + w.decode()
        scored = {r[0]: r for r in plain_scores([*rows, (7, text), (7, "a")], 2, 5.0)}
        assert held_out(7, 5, 1) == scored[7][1]
        del scored
    counts = Counter()
    for _, t in rows:
        s = [b"\n", *t.encode().split(), b"\n"]
        counts.update(zip(s[1:]))
        counts.update(zip(s, s[1:]))
    scale = sum(c for k, c in counts.items() if len(k) == 1) + 0.5 * (len(types) + 1)
    for w in [*types, b"unknown"]:
        total += (counts[b"a", w] + 5 * (counts[w,] + 0.5) / scale) / (counts[b"a",] + 5)
    assert total == pytest.approx(1)


def test_the_query_sees_more_than_the_word_before(spark):
    rows = [(i, t) for i, t in enumerate(["a b c", "x b d"] * 40) if not held_out(i, 5, 1)]
    asked = [i for i in range(100, 200) if held_out(i, 5, 1)][:2]
    docs = spark.createDataFrame(rows + list(zip(asked, ["a b c", "a b d"])), "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in language_model.scored(docs).collect()}
    assert score[asked[0]] > score[asked[1]] + 0.1


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("stretch", [4, 7, 256])
def test_stretches_carry_the_state(order, stretch):
    rng = random.Random(order)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (0, 1, 3, 4, 5, 30, 200, 11)]
    rows = [(i, t) for i, t in enumerate(texts)]
    learns = [not held_out(i, 5, 1) for i, _ in rows]
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": texts, "train": learns, "block": [0] * len(rows)})
    block = language_model._block(pa.Table.from_batches(language_model._packs(iter([batch]))), order)
    want = [r[-1] for r in plain_scores(rows, order, 3.0)]
    learned = Counter(w for i, t in rows if not held_out(i, 5, 1) for w in [*words(t), b"\n"])
    machine, known = language_model.automaton(
        block, [block.own[at] for at in block.at], 3.0, sum(learned.values()) + 0.5 * (len(learned) + 1)
    )
    assert language_model.traversed(machine, block.flat, block.size, order, stretch) == pytest.approx(want, rel=1e-9)
    assert sorted(known[known > 0]) == sorted(learned.values())
    assert (machine.fail < np.arange(len(machine.fail)) + (np.arange(len(machine.fail)) == 0)).all()  # failure leads to a shorter history


def plain_tiles(doc, item, tile):
    """Greedy string tiling as it is defined: look for the longest free match again and again."""
    free_d, free_i, covered = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (tile - 1, 0, 0)
        for x in range(len(doc)):
            for y in range(len(item)):
                n = 0
                while x + n < len(doc) and y + n < len(item) and doc[x + n] == item[y + n] and free_d[x + n] and free_i[y + n]:
                    n += 1
                if n > best[0]:
                    best = (n, x, y)
        n, x, y = best
        if n < tile:
            return covered
        covered += n
        for k in range(n):
            free_d[x + k] = free_i[y + k] = False


def test_tiles():
    rng = random.Random(4)
    for _ in range(150):
        item = [rng.choice("abcdef") for _ in range(rng.randrange(0, 25))]
        doc = [rng.choice("abcdef") for _ in range(rng.randrange(0, 30))] + item[10:] + item[:10]
        got = tiling.tiled(tiling.tokens(" ".join(doc)), tiling.tokens(" ".join(item)), 3)
        assert got[0] == sum(n for _, _, n in got[1]) == plain_tiles(doc, item, 3)


def test_reordered_passages_are_caught(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    half = item.split()
    docs = spark.createDataFrame(
        [(1, "x " + " ".join(half[8:]) + " between " + " ".join(half[:8])), (2, item.upper() + "!"), (3, " ".join(half[:6])), (4, "nothing here"), (5, " ".join(reversed(half)))],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(9, item), (8, "other words that are not in any text at all")], "item_id long, text string")
    for size in (1 << 25, 0):
        got = {r["doc_id"]: (r["kept"], r["item_ids"]) for r in tiling.coverage(docs, items, broadcast_chars=size).collect()}
        assert got == {1: (False, [9]), 2: (False, [9]), 3: (True, []), 4: (True, []), 5: (True, [])}


@needs
def test_both_ways_agree(spark):
    docs, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    a, b = (sorted(map(tuple, tiling.coverage(docs, items, broadcast_chars=n).collect())) for n in (1 << 25, 0))
    assert a == b and any(not r[3] for r in a)


def test_both_ways_keep_the_same_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(None, item), (None, "clean"), (None, None), (3, item), (3, "clean too"), (4, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    for size in (1 << 25, 0):
        got = sorted((r[0] or 0, r[1] or "") for r in tiling.clean(docs, items, broadcast_chars=size).collect())
        assert got == [(0, ""), (0, "clean"), (3, "clean too"), (4, "clean")]
