"""Vector codes by product quantisation; nearest entries by slice-and-intersect bitmasks.

The entries of a part's codebook are sorted once per coordinate. Prefix masks say which entries are
among the first i of that order, so the entries within a radius on one coordinate are the exclusive
or of two prefixes, four uint64 words for 256 entries. The AND over all coordinates leaves the
entries of a box around the vector; only these are measured. A box whose best distance is no more
than its radius holds the nearest entry and all its ties. Else the best distance found gives the
radius of a second box that does, and an empty box is doubled first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import cut_lineage

SCALE = 1024
#: Larger integers are cut to this size, so that squared distances stay within a long.
BOUND = 1 << 26
_ROWS = 4096
_PAIRS = 1 << 20
_EXACT = 1 << 20  # products of integers under this size add up exactly in doubles


class Slices:
    """Sorted coordinates of the entries (n x d integers, n at most 256) with prefix masks."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.asarray(entries, np.int64)
        n, d = self.entries.shape
        self.words = (n + 63) // 64
        self.order = np.argsort(self.entries, axis=0, kind="stable")
        self.sorted = [np.ascontiguousarray(np.take_along_axis(self.entries, self.order, 0)[:, j]) for j in range(d)]
        bit = np.zeros((n, self.words), np.uint64)
        bit[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        self.prefix = []  # per coordinate: (n + 1) x words
        for j in range(d):
            self.prefix.append(np.r_[np.zeros((1, self.words), np.uint64), np.bitwise_or.accumulate(bit[self.order[:, j]], axis=0)])
        # half the median distance from an entry to the nearest other one
        gaps = [self._gap(i) for i in range(n)] if n > 1 else [0]
        self.radius = max(1, int(np.sqrt(float(np.median(gaps))) / 2))
        self.floats, self.square = self.entries.astype(np.float64), (self.entries**2).sum(axis=1)

    def _gap(self, i: int) -> int:
        away = ((np.delete(self.entries, i, 0) - self.entries[i]) ** 2).sum(axis=1)
        return int(away.min())

    def box(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """A row of booleans for each row of x: the entries whose every coordinate is within the row's radius of it."""
        mask = np.full((len(x), self.words), np.iinfo(np.uint64).max, np.uint64)
        for j, (values, prefix) in enumerate(zip(self.sorted, self.prefix)):
            low = np.searchsorted(values, x[:, j] - radius, "left")
            high = np.searchsorted(values, x[:, j] + radius, "right")
            mask &= prefix[high] ^ prefix[low]
        bits = np.unpackbits(mask.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
        return bits[:, : len(self.entries)].view(bool)

    def _best(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of the nearest in each box, ties to the lower entry; -1 where a box is empty."""
        inside = self.box(x, radius)
        if inside.mean() > 1 / 16 and np.abs(x).max() < _EXACT and np.abs(self.entries).max() < _EXACT:
            # boxes of many entries: their distances by one matrix product, exact in doubles at this size
            away = (x**2).sum(axis=1)[:, None] + self.square - 2 * (x.astype(np.float64) @ self.floats.T).astype(np.int64)
            away[~inside] = np.iinfo(np.int64).max
            best = away.argmin(axis=1)
            error = away[np.arange(len(x)), best]
            found = inside.any(axis=1)
            return np.where(found, best, -1), np.where(found, error, 0)
        row, entry = np.nonzero(inside)
        away = np.empty(len(row), np.int64)
        for k in range(0, len(row), _PAIRS):
            gap = x[row[k : k + _PAIRS]] - self.entries[entry[k : k + _PAIRS]]
            away[k : k + _PAIRS] = np.einsum("ij,ij->i", gap, gap)
        best, error = np.full(len(x), -1, np.int64), np.zeros(len(x), np.int64)
        if len(row):
            starts = np.flatnonzero(np.r_[True, np.diff(row) > 0])
            least = np.minimum.reduceat(away, starts)
            hits = np.flatnonzero(away == np.repeat(least, np.diff(np.r_[starts, len(row)])))
            first = hits[np.r_[True, np.diff(row[hits]) > 0]]
            best[row[first]], error[row[first]] = entry[first], away[first]
        return best, error

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) for each row of x, exact, ties to the lower entry."""
        best, error = np.full(len(x), -1, np.int64), np.zeros(len(x), np.int64)
        radius = np.full(len(x), self.radius, np.int64)
        open_ = np.arange(len(x))
        while len(open_):
            best[open_], error[open_] = self._best(x[open_], radius[open_])
            empty = best[open_] < 0
            root = np.sqrt(error[open_].astype(np.float64)).astype(np.int64) + 1  # no entry of this distance is farther on a coordinate
            wide = ~empty & (error[open_] > radius[open_] ** 2)
            radius[open_] = np.where(empty, 2 * radius[open_], root)
            open_ = open_[empty | wide]
        return best, error


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 x), cut to +-BOUND."""
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -BOUND, BOUND).astype(np.int64)


def _matrix(batch: pa.RecordBatch, dims: int, width: int) -> np.ndarray:
    """Rows of width integers; components past the vectors' own dims are zero."""
    column = batch["vector"]
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return np.pad(integers(flat), ((0, 0), (0, width - dims)))


def vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, vector) of the rows whose vector is there, not empty, and holds finite numbers only."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (
        df.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
        .where(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", number))
    )


def first_vectors(kept: DataFrame, entries: int) -> list[list[float]]:
    """The vectors of the smallest ids (null ids last, repeated ids by their vectors): ``entries`` rows at most."""
    rows = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    return [r["vector"] for r in rows]


def _assigned(kept: DataFrame, books: np.ndarray, dims: int) -> DataFrame:
    """Per task: (part, entry, count, sums) of the vectors that lie nearest to each entry."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        slices = [Slices(b) for b in books]
        for batch in batches:
            for k in range(0, batch.num_rows, _ROWS):
                x = _matrix(batch.slice(k, _ROWS), dims, parts * width)
                for p in range(parts):
                    mine = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
                    best, _ = slices[p].nearest(mine)
                    order = np.argsort(best, kind="stable")
                    starts = np.flatnonzero(np.r_[True, np.diff(best[order]) > 0])
                    sums[p, best[order][starts]] += np.add.reduceat(mine[order], starts, axis=0)
                    count[p] += np.bincount(best, minlength=books.shape[1])
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": pa.array(count[part, entry]),
            "sums": pa.array(list(sums[part, entry]), pa.list_(pa.int64())),
        })

    return kept.select("vector").mapInArrow(run, "part int, entry int, n long, sums array<long>")


def refined(kept: DataFrame, books: np.ndarray, dims: int) -> np.ndarray:
    """The codebooks after one round: each entry is the floor of the mean of its parts; unused entries stay.

    One row per part and entry comes back, whatever the table's size.
    """
    width = books.shape[2]
    means = (
        _assigned(kept, books, dims).groupBy("part", "entry")
        .agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)))
    )
    new = books.copy()
    for r in means.collect():
        new[r["part"], r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
    return new


def codebooks(kept: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[np.ndarray, int]:
    """((parts, entries, width) integers, components of a vector): trained from the first vectors by whole rounds.

    The vectors' size is that of the first one; where it isn't a multiple of ``parts``, zeros fill it up.
    """
    first = first_vectors(kept, entries)
    if not first:
        return np.zeros((parts, 0, 0), np.int64), 0
    dims = len(first[0])
    width = -(-dims // parts)
    sized = kept.where(F.size("vector") == dims)
    if any(len(v) != dims for v in first):
        first = first_vectors(sized, entries)
    whole = np.pad(integers(np.array(first)), ((0, 0), (0, parts * width - dims)))
    books = whole.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = refined(sized, books, dims)
    return books, dims


def encoded(kept: DataFrame, books: np.ndarray, dims: int) -> DataFrame:
    """(vec_id, label, code, error): hex indexes of the nearest entries in part order, and the sum of squared distances."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        for batch in batches:
            for k in range(0, batch.num_rows, _ROWS):
                part = batch.slice(k, _ROWS)
                x = _matrix(part, dims, parts * width)
                found = [slices[p].nearest(np.ascontiguousarray(x[:, p * width : (p + 1) * width])) for p in range(parts)]
                code = [bytes(row).hex() for row in np.stack([best for best, _ in found], axis=1).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [part["vec_id"], part["label"], pa.array(code, pa.string()), pa.array(sum(error for _, error in found), pa.int64())],
                    ["vec_id", "label", "code", "error"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    return kept.where(F.size("vector") == dims).mapInArrow(run, schema)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimals with commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compressed(df: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for every row with a whole vector.

    Rows whose vector is null, empty or holds null or non-finite components are dropped, and those
    whose size is not that of the vector with the smallest id. A null id or label is kept; null
    labels count as one. Rows that repeat an id each have their code. Equal distances go to the lower
    entry. With fewer rows than entries, each is an entry; an empty table gives an empty result.
    Other columns are not read. The driver holds the codebooks only (parts x entries rows); each
    round reads the table once and sends one row per part and entry and task to the shuffle.
    """
    kept = vectors(df, key, vector, label)
    books, dims = codebooks(kept, parts, entries, rounds)
    codes = cut_lineage(encoded(kept, books, dims))
    totals = codes.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    return codes.join(totals, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"),
    )


def _sql(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """The same in SQL: one pair of common tables per round."""
    distance = "xx - 2 * list_dot_product(x::DOUBLE[], c::DOUBLE[])::BIGINT + cc"
    text = [f"""WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) > 0 AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda e: isfinite(e))) = len(embedding)),
v AS MATERIALIZED (
  SELECT vec_id, label, part, x, list_dot_product(x::DOUBLE[], x::DOUBLE[])::BIGINT AS xx FROM (
    SELECT vec_id, label, part, e[part * len(e) // {parts} + 1 : (part + 1) * len(e) // {parts}] AS x FROM k, range({parts}) t(part))),
b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c, xx AS cc FROM v
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {entries})"""]
    for r in range(rounds):
        text.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, d * {entries} + entry) AS entry FROM (
    SELECT v.vec_id, v.part, b.entry, {distance} AS d FROM v JOIN b{r} b USING (part)) GROUP BY ALL),
m{r} AS MATERIALIZED (
  SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
    SELECT part, entry, i, sum(y)::BIGINT AS s, count(*) AS n FROM (
      SELECT part, entry, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{r} JOIN v USING (vec_id, part)) GROUP BY ALL) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (
  SELECT part, entry, c, list_dot_product(c::DOUBLE[], c::DOUBLE[])::BIGINT AS cc FROM (
    SELECT part, entry, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (part, entry)))""")
    text.append(f"""f AS MATERIALIZED (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM (
    SELECT vec_id, label, part, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d FROM (
      SELECT v.vec_id, v.label, v.part, b.entry, {distance} AS d FROM v JOIN b{rounds} b USING (part)) GROUP BY ALL) GROUP BY ALL),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM f, h""")
    return ",\n".join(text)


SQL = _sql()
