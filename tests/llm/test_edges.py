"""Nulls, empty and long texts, repeated rows, empty tables and clashing names, for every operator and stage."""

import public_tokenizers
import pytest

from loomgraph.llm import bpe, exact, html_text, language_model, pii, quality, repair, simhash, tiling, toxicity

from .helpers import CLASHES, ODD, empty, labels, odd

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SAMPLE = [(4, 1, 0), (5, 1, 0), (6, 0, 1), (11, None, None), (99, 1, 1), (None, 1, 1), (4, 0, 0)]


def bench(spark, rows=((1, "some words that no text has in it"), (2, None), (3, "short"), (1, "some words that no text has in it"))):
    return spark.createDataFrame(list(rows), "item_id long, text string").selectExpr("*", "1 kept", "text doc_id")


OPERATORS = {
    "quality": lambda s, d: quality.scored(d, labels(s, SAMPLE)),
    "quality without labels": lambda s, d: quality.scored(d, labels(s)),
    "shards": lambda s, d: repair.stored(d, BYTE),
    "bpe": lambda s, d: bpe.encoded(d, WORD),
    "toxicity": lambda s, d: toxicity.scored(d, labels(s, SAMPLE)),
    "toxicity without labels": lambda s, d: toxicity.scored(d, labels(s)),
    "simhash": lambda s, d: simhash.near_groups(d),
    "language model": lambda s, d: language_model.scored(d),
    "tiling": lambda s, d: tiling.coverage(d, bench(s)),
    "tiling joined": lambda s, d: tiling.coverage(d, bench(s), broadcast_chars=0),
    "tiling without items": lambda s, d: tiling.coverage(d, bench(s).limit(0)),
    "exact": lambda s, d: exact.groups(d),
    "pii": lambda s, d: pii.spans(d),
    "sanitised": lambda s, d: pii.sanitised(d),
    "html": lambda s, d: html_text.extracted(d.selectExpr("doc_id page_id", "cast(null as string) url", "text html", "score text")),
}
STAGES = {
    "toxicity": lambda s, d: toxicity.clean(d, labels(s, SAMPLE)),
    "exact": lambda s, d: exact.deduplicated(d),
    "simhash": lambda s, d: simhash.deduplicated(d),
    "tiling": lambda s, d: tiling.clean(d, bench(s)),
    "tiling joined": lambda s, d: tiling.clean(d, bench(s), broadcast_chars=0),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(spark, name):
    rows = OPERATORS[name](spark, odd(spark)).collect()
    left_out = 2 if name == "shards" else 0  # rows without an id have no place in the order
    assert len(rows) == len(ODD) - left_out
    key = "page_id" if name == "html" else "doc_id"
    assert sorted(r[key] or 0 for r in rows) == sorted(i or 0 for i, _ in ODD if i or not left_out)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, empty(spark)).collect() == []


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(spark, name):
    got = STAGES[name](spark, odd(spark))
    assert got.columns == ["doc_id", "text", *CLASHES]
    assert all(r["lang"] == CLASHES.index("lang") for r in got.collect())
    assert STAGES[name](spark, empty(spark)).collect() == []


def test_scores_without_labels(spark):
    for op in (quality, toxicity):
        assert {r["score"] for r in op.scored(odd(spark), labels(spark)).collect()} == {0.5}
    assert toxicity.clean(odd(spark), labels(spark)).count() == len(ODD)
