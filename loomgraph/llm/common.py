"""What the text operators share: the input view, hold-out folds, word splitting and Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java and RE2 class of the white space that parts words.
SPACE = r"\x20\x09-\x0D"


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) of a table, whatever else it holds; a null text counts as empty."""
    return df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def fold(key: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds (a null id: null)."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def words(text: str) -> list[bytes]:
    """Words of a text in UTF-8 with A-Z lower-cased.

    bytes.lower() and bytes.split() know ASCII letters and the six ASCII white spaces only.
    """
    return text.encode("utf-8", "surrogatepass").lower().split()


def pieces(batch: pa.RecordBatch, text: str = "text", chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many characters each (a longer row comes alone)."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch[text]), 0), dtype=np.int64)
    start = 0
    at = np.cumsum(size)
    while start < batch.num_rows:
        base = at[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(at, base + chars, "right")))
        yield batch.slice(start, end - start)
        start = end


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have (names that differ in case only are the same)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(df: DataFrame, least: int = 1) -> int:
    """Partitions for a shuffle by key: as the session sets them."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def binaries(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary per row out of a flat array cut at the given bounds (in items)."""
    data = np.ascontiguousarray(flat)
    return pa.Array.from_buffers(
        pa.large_binary(), len(bounds) - 1,
        [None, pa.py_buffer((np.asarray(bounds, np.int64) * data.itemsize).tobytes()), pa.py_buffer(data.tobytes())],
    ).cast(pa.binary())


def kept_rows(df: DataFrame, keep, text: str = "text") -> DataFrame:
    """The rows whose text ``keep`` accepts, with all columns and without a shuffle.

    ``keep()`` is called once per task and gives a function from a list of texts to a boolean mask.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accept = keep()
        for batch in batches:
            for part in pieces(batch, text):
                yield part.filter(pa.array(np.asarray(accept([t or "" for t in part[text].to_pylist()]), bool)))

    return df.mapInArrow(run, df.schema)
