"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Texts are bags of hashed words, word shapes and layout marks, weighted by inverse document frequency and
projected on the leading singular vectors of a bounded labelled sample. The labelled vectors are broadcast; every
document's exact cosines with all of them are computed in blocks, and the labels of its nearest ones are
averaged by similarity.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import fold, pieces, texts
from loomgraph.llm.labelled import sample

_WORD = re.compile(r"\w+").findall
_RUN = re.compile(rb"([^ \n])\1+")
#: Lower-case and non-ASCII bytes become a, upper-case ones A, digits 0, white space stays apart from marks.
_SHAPE = bytes(
    97 if 97 <= b <= 122 or b > 127 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 10 if b == 10 else 32 if b < 33 else b for b in range(256)
)


@dataclass(frozen=True)
class Settings:
    """sample: the most labelled rows that are read, broadcast and compared with (sample x rank floats);
    width: hashed coordinates; rank: latent dimensions; neighbours: votes; power: of a similarity as weight."""

    sample: int = 4_000
    width: int = 4_096
    rank: int = 64
    neighbours: int = 25
    power: float = 4.0
    block: int = 256


def _share(name: str, part: float, whole: float) -> str:
    return f"{name}:{round(8 * part / whole) if whole else -1}"


def features(text: str, width: int) -> np.ndarray:
    """log(1 + times) of each hashed coordinate (the whole text; an empty one has its layout marks only)."""
    lower = text.lower()
    words = _WORD(lower.encode("utf-8", "replace").decode())
    coded = text.encode("utf-8", "replace").translate(_SHAPE)
    shapes = Counter(_RUN.sub(rb"\1", coded).split())
    lines = [x for x in text.split("\n") if x.strip()]
    total = sum(shapes.values())
    marks = [
        f"length:{len(text).bit_length()}", f"lines:{len(lines).bit_length()}", f"line:{(len(text) // max(1, len(lines))).bit_length()}",
        _share("same lines", len(set(lines)), len(lines)), _share("same words", len(set(words)), len(words)),
        _share("upper", coded.count(b"A"), len(coded)), _share("digits", coded.count(b"0"), len(coded)), _share("letters", coded.count(b"a"), len(coded)),
        _share("spaces", coded.count(b" "), len(coded)), _share("bare words", shapes[b"a"] + shapes[b"Aa"], total),
    ]
    at = np.fromiter(map(crc32, map(str.encode, words)), np.uint32, len(words)) % np.uint32(width // 2)
    out = np.bincount(at, minlength=width).astype(np.float32)
    for shape, times in shapes.items():
        out[width // 2 + crc32(b"shape " + shape) % (width // 2)] += times
    for mark in marks:
        out[width // 2 + crc32(mark.encode()) % (width // 2)] += 7
    return np.log1p(out, out=out)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(x: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Term weights folded into the projection (width x rank), and the labelled vectors: a randomised SVD in two power steps."""
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32)
    x = unit(x * idf)
    q = np.random.default_rng(0).standard_normal((s.width, s.rank + 16)).astype(np.float32)
    for _ in range(3):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    top = (q @ vt.T)[:, : s.rank]
    return idf[:, None] * top, unit(x @ top)


def train(rows: DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Projection, labelled vectors and labels of the bounded (text, label, place) sample; None if it is empty.

    Features are made where the documents are; one task sees the sample, in hash order, and gives one row of
    (width + sample) x rank floats at most.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                x = [features(t, s.width).astype(np.float16).tobytes() for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["place"], part["label"], pa.array(x, pa.binary())], ["place", "label", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = [], []
        for batch in batches:
            x += [np.frombuffer(b, np.float16) for b in batch["x"].to_pylist()]
            y += batch["label"].to_pylist()
        if y:
            top, vectors = fit(np.array(x, np.float32), s)
            yield pa.RecordBatch.from_pydict({"top": [top.astype(np.float32).tobytes()], "vectors": [vectors.astype(np.float32).tobytes()], "labels": [np.array(y, np.float32).tobytes()]})

    found = (
        rows.mapInArrow(hashed, "place long, label int, x binary").repartition(1).sortWithinPartitions("place")
        .mapInArrow(learn, "top binary, vectors binary, labels binary").collect()
    )
    if not found:
        return None
    top, vectors, labels = (np.frombuffer(b, np.float32) for b in found[0])
    return top.reshape(s.width, -1), vectors.reshape(len(labels), -1), labels


def vote(x: np.ndarray, vectors: np.ndarray, labels: np.ndarray, s: Settings) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors; ties go to the earlier ones."""
    similar = np.maximum(unit(x) @ vectors.T, 0)
    k = min(s.neighbours, len(labels))
    near = np.argsort(-similar, axis=1, kind="stable")[:, :k] if len(labels) <= k else np.argpartition(-similar, k - 1, axis=1)[:, :k]
    weight = np.take_along_axis(similar, near, axis=1) ** s.power
    total = weight.sum(axis=1)
    return np.where(total > 0, (weight * labels[near]).sum(axis=1) / np.where(total > 0, total, 1), labels.mean())


def scored(docs: DataFrame, labels: DataFrame, folds: int = 4, out: int = 2, threshold: float = 0.7, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    score is the share of label 1 among the neighbours; predicted is 1 from ``threshold`` on. Null and empty
    texts are scored by their layout marks. Without any labels all scores are 0.5. Rows that repeat
    an id are scored each on its own text; a null id is not held out.
    """
    model = train(sample(docs, labels, "quality", folds, out, settings.sample), settings)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # (width + 2 sample) x rank floats at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for big in pieces(batch):
                for at in range(0, big.num_rows, settings.block):
                    part = big.slice(at, settings.block)
                    if sent.value is None:
                        score = np.full(part.num_rows, 0.5)
                    else:
                        top, vectors, y = sent.value
                        x = np.array([features(t, settings.width) for t in part["text"].to_pylist()], np.float32)
                        score = np.clip(vote(x @ top, vectors, y, settings), 0, 1)
                    yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(score.astype(float))], ["doc_id", "score"])

    source = texts(docs)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double").select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), folds) == out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
