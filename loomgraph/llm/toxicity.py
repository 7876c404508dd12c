"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import fold, kept_rows, pieces, texts
from loomgraph.llm.labelled import sample

_WORD = re.compile(r"\w+").findall


@dataclass(frozen=True)
class Settings:
    """bits: coordinates are 2^bits; sample: the most labelled rows that are read to fit; alpha, beta:
    the per-coordinate rate alpha / (beta + sqrt(sum of squared gradients)); l1, l2: the penalties;
    refits: passes without l1 over the coordinates that were selected, which undoes its shrinking."""

    bits: int = 20
    sample: int = 8_000
    epochs: int = 4
    refits: int = 12
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 20.0
    l2: float = 0.1


def features(text: str, bits: int) -> np.ndarray:
    """Hashed coordinates of a text, each once: words, pairs, pairs over one word and triples."""
    word = np.fromiter(map(crc32, map(str.encode, _WORD(text.lower().encode("utf-8", "replace").decode()))), np.uint64)
    kinds = [word]
    if len(word) > 1:
        kinds.append(word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:])
    if len(word) > 2:
        kinds.append(word[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + word[2:])
        kinds.append(kinds[1][:-1] * np.uint64(0x165667B19E3779F9) + word[2:])
    mixed = np.concatenate([(k + np.uint64(i)) * np.uint64(0xD6E8FEB86659FD93) for i, k in enumerate(kinds)])
    return np.unique((mixed >> np.uint64(64 - bits)).astype(np.uint32))


def passes(rows: list[np.ndarray], labels: np.ndarray, s: Settings, epochs: int, l1: float) -> tuple[np.ndarray, float]:
    """FTRL-proximal in the given order: the dense weights and the intercept (which has no l1)."""
    z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)
    zb = nb = 0.0

    def weight(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    for _ in range(epochs):
        for at, y in zip(rows, labels):
            w, wb = weight(z[at], n[at], l1), float(weight(zb, nb, 0.0))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35))) - y
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha * w
            n[at] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / s.alpha * wb
            nb += g * g
    return weight(z, n, l1), float(weight(zb, nb, 0.0))


def fit(rows: list[np.ndarray], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Selected coordinates, their weights and the intercept."""
    chosen = passes(rows, labels, s, s.epochs, s.l1)[0] != 0
    w, base = passes([x[chosen[x]] for x in rows], labels, s, s.refits, 0.0)
    used = np.flatnonzero(w)
    return used, w[used], base


def train(rows: DataFrame, s: Settings) -> tuple[np.ndarray, float]:
    """Dense weights (2^bits floats) and intercept from the bounded (text, label, place) sample.

    Features are made where the documents are; one task then sees the sample in hash order, as the
    method is sequential. What comes back has at most 2^bits rows, whatever the input.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                at = [features(t, s.bits).tobytes() for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["place"], part["label"], pa.array(at, pa.binary())], ["place", "label", "at"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, y = [], []
        for batch in batches:
            at += [np.frombuffer(x, np.uint32) for x in batch["at"].to_pylist()]
            y += batch["label"].to_pylist()
        if y:
            used, weights, base = fit(at, np.array(y, float), s)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[used, -1]), pa.array(np.r_[weights, base])], ["coordinate", "weight"])

    found = (
        rows.mapInArrow(hashed, "place long, label int, at binary").repartition(1).sortWithinPartitions("place")
        .mapInArrow(learn, "coordinate long, weight double").toPandas()
    )
    dense, base = np.zeros(1 << s.bits, np.float32), 0.0
    at, w = found["coordinate"].to_numpy(), found["weight"].to_numpy()
    dense[at[at >= 0]] = w[at >= 0]
    if len(found):
        base = float(w[at < 0][0])
    return dense, base


def scorer(docs: DataFrame, labels: DataFrame, folds: int, out: int, s: Settings):
    """A factory, for use in tasks, of a function from texts to probabilities; fits and broadcasts the weights."""
    dense, base = train(sample(docs, labels, "toxic", folds, out, s.sample), s)
    used = np.flatnonzero(dense).astype(np.uint32)
    sent = docs.sparkSession.sparkContext.broadcast((used, dense[used], base))  # 2^bits pairs at most

    def make():
        used, weights, base = sent.value
        dense = np.zeros(1 << s.bits, np.float32)
        dense[used] = weights

        def score(batch: list[str]) -> np.ndarray:
            sums = np.array([dense[features(t, s.bits)].sum(dtype=float) for t in batch], float)
            return 1 / (1 + np.exp(-np.clip(sums + base, -35, 35)))

        return score

    return make


def scored(docs: DataFrame, labels: DataFrame, folds: int = 5, out: int = 0, threshold: float = 0.5, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    score is the model's probability of label 1; predicted is 1 from ``threshold`` on. Null and empty texts have
    the score of the intercept alone. Without any labels all scores are 0.5. Rows that repeat an id
    are scored each on its own text; a null id is not held out. Labels are read from the folds
    other than ``out`` only.
    """
    make = scorer(docs, labels, folds, out, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            for part in pieces(batch):
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(score(part["text"].to_pylist()))], ["doc_id", "score"])

    source = texts(docs)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double").select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), folds) == out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def clean(docs: DataFrame, labels: DataFrame, folds: int = 5, out: int = 0, threshold: float = 0.5, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``, with all their columns; without labels all stay."""
    if not labels.where("toxic is not null").take(1):
        return docs
    make = scorer(docs, labels, folds, out, settings)

    def keep():
        score = make()
        return lambda batch: score(batch) < threshold

    return kept_rows(docs, keep)
