"""Exact nearest neighbours by a pivot index: blocks of the corpus that can hold none of the best are skipped.

Pivots are corpus rows in hash order, a bounded number. Every corpus row belongs to its nearest pivot;
a block knows its radius, the largest distance of its rows to the pivot. A query is first compared
with the blocks of its nearest pivots, as many as hold k rows. The k-th best score found there bounds
what is left: by the triangle inequality a row of a block is at least (distance to the pivot - radius)
away, and a block whose bound is beyond the k-th best is never visited. Blocks with many rows are
split by id, and so are the queries that visit one block, so cells stay bounded.

Where most blocks would have to be visited (vectors without clusters), sending each query to each block
costs more than it saves: then all pairs are compared in a grid of large blocks. The rows are the same.

Cosine is compared as the distance of unit vectors, |q - c|^2 = 2 - 2 cos.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.hashing import seeded_hash
from loomgraph.operators.nearest import BLOCK_ROWS, EXPANSION, TILE_CELLS, _compare, _count_kernel, _fresh, _matrix, _merge, _placed, _result, _unit, _vector_kernel, count_better, nearest_vectors
from loomgraph.session import cut_lineage

MOST_PIVOTS = 1024
FEW_VISITS = 1 / 8  # share of the blocks that a query may visit on average
_VISITS = 2**16  # (query, block) rows that a task makes at once
_SLACK = 1e-7  # for the rounding of distances


def choose_pivots(corpus: DataFrame, rows: int, block_rows: int = BLOCK_ROWS, most: int = MOST_PIVOTS, seed: int = 42) -> np.ndarray:
    """About four pivots for each ``block_rows`` of the corpus, ``most`` at most: the first rows in hash order."""
    n = max(1, min(most, 4 * rows // block_rows))
    found = corpus.orderBy(seeded_hash(seed, F.col("id")), "id").limit(n).select("vec").collect()
    return np.array([r["vec"] for r in found], np.float64)


def _points(column, rows: int, metric: str) -> np.ndarray:
    m = _matrix(column, rows)
    return _unit(m) if metric == "cosine" else m


def _distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (m * m).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2.0 * (m @ pivots.T)
    return np.sqrt(np.maximum(square, 0.0))


def assigned(corpus: DataFrame, pivots: np.ndarray, metric: str) -> DataFrame:
    """The corpus with ``pivot``, the number of the nearest one, and ``away``, the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_points(pa.chunked_array([batch["vec"]]), batch.num_rows, metric), pivots)
            nearest = d.argmin(axis=1)
            extra = [pa.array(nearest, pa.int32()), pa.array(d[np.arange(len(d)), nearest])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "pivot", "away"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in corpus.schema)
    return corpus.mapInArrow(run, f"{kinds}, pivot int, away double")


def farthest(score: np.ndarray, metric: str, digits: int, factor: float) -> np.ndarray:
    """Distance beyond which no row can score ``score`` after rounding (and a boost by ``factor``)."""
    least = score - 10.0**-digits
    if metric == "cosine":
        least = np.where(least > 0, least / factor, least)
        return np.sqrt(np.maximum(2.0 - 2.0 * least, 0.0)) + _SLACK
    return -least + _SLACK


def visits(queries: DataFrame, pivots: np.ndarray, size: np.ndarray, radius: np.ndarray, need: int, metric: str, digits: int, factor: float, count: bool = False) -> DataFrame:
    """The queries with ``pivot``, a row for each block to visit.

    Without a column ``cut`` those of the nearest pivots that hold ``need`` rows together; with it (the
    k-th best score so far, null: none) all others that may hold a row as good.
    """
    bounded = "cut" in queries.columns

    def asked(batch: pa.RecordBatch) -> np.ndarray:
        d = _distances(_points(pa.chunked_array([batch["vec"]]), batch.num_rows, metric), pivots)
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(size[order], axis=1) - size[order]
        first = np.zeros(d.shape, bool)
        np.put_along_axis(first, order, before < need, 1)
        if not bounded:
            return first & (size > 0)
        cut = batch["cut"].to_numpy(zero_copy_only=False).astype(np.float64)
        reach = np.where(np.isnan(cut), np.inf, farthest(np.nan_to_num(cut), metric, digits, factor))
        return ~first & (size > 0) & (d - radius <= reach[:, None])

    return _visited(queries, asked, len(pivots), count)


def _parts(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices that make at most _VISITS rows, whatever the number of blocks."""
    rows = max(1, _VISITS // max(1, blocks))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _visited(queries: DataFrame, asked, blocks: int, count: bool = False) -> DataFrame:
    """A row for each (query, block) that ``asked`` marks, with ``pivot``; or only how many there are (n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, blocks):
            if count:
                yield pa.RecordBatch.from_arrays([pa.array([int(asked(batch).sum())], pa.int64())], ["n"])
                continue
            row, pivot = np.nonzero(asked(batch))
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(row)) for c in batch.columns), pa.array(pivot, pa.int32())], [*batch.schema.names, "pivot"]
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(run, "n bigint" if count else f"{kinds}, pivot int")


def _few(counted: DataFrame, queries: int, blocks: int) -> bool:
    """Whether the visits are few enough to send each query to each of its blocks."""
    return (counted.agg(F.sum("n")).head()[0] or 0) <= queries * max(1.0, FEW_VISITS * blocks)


def _compared(asked: DataFrame, placed: DataFrame, size: np.ndarray, block_rows: int, kernel, schema: str) -> DataFrame:
    """Every asked (query, block) pair compared in cells of bounded size."""
    counted = asked.groupBy("pivot").agg(F.count("*").alias("n_asked"))
    corpus_cells = F.array(*[F.lit(int(max(1, -(-n // block_rows)))) for n in size])
    slices = asked.join(counted, "pivot").withColumn("q_cells", F.ceil(F.col("n_asked") / block_rows).cast("int")).drop("n_asked")
    left = (
        slices.withColumn("q_block", F.pmod(F.xxhash64("id"), F.col("q_cells")).cast("int"))
        .withColumn("c_block", F.explode(F.sequence(F.lit(0), F.get(corpus_cells, F.col("pivot")) - 1))).drop("q_cells")
    )
    right = (
        placed.join(counted.select(F.col("pivot"), F.ceil(F.col("n_asked") / block_rows).cast("int").alias("q_cells")), "pivot")
        .withColumn("c_block", F.pmod(F.xxhash64("id"), F.get(corpus_cells, F.col("pivot"))).cast("int"))
        .withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("q_cells") - 1))).drop("q_cells")
    )
    keys = ["pivot", "q_block", "c_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(kernel, schema)


class PivotIndex:
    """A corpus (id, vec and, for a boost, category) by nearest pivot, written to the shared folder."""

    def __init__(self, corpus: DataFrame, metric: str = "cosine", block_rows: int = BLOCK_ROWS, most: int = MOST_PIVOTS, seed: int = 42):
        self.metric, self.block_rows = metric, block_rows
        corpus = cut_lineage(corpus)
        self.rows = corpus.count()
        self.pivots = choose_pivots(corpus, self.rows, block_rows, most, seed)
        if metric == "cosine" and len(self.pivots):
            self.pivots = _unit(self.pivots)
        self.size, self.radius = np.zeros(len(self.pivots), np.int64), np.zeros(len(self.pivots))
        self.placed = corpus
        if self.rows:
            self.placed = cut_lineage(assigned(corpus, self.pivots, metric))
            for r in self.placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect():  # a row per pivot
                self.size[r["pivot"]], self.radius[r["pivot"]] = r["n"], r["r"]

    def first_visits(self, queries: DataFrame, need: int, digits: int = 6, factor: float = 1.0, count: bool = False) -> DataFrame:
        return visits(queries, self.pivots, self.size, self.radius, need, self.metric, digits, factor, count)

    later_visits = first_visits  # the same with a column ``cut``


def nearest_pruned(
    queries: DataFrame,
    corpus: DataFrame | PivotIndex,
    k: int,
    metric: str = "cosine",
    exclude_self: bool = False,
    boosted: Sequence[str] = (),
    boost: float = 0.5,
    digits: int = 6,
    names: tuple[str, str, str] = ("context", "neighbour", "similarity"),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The rows of nearest_vectors(), without comparing blocks that can't hold one of the k best.

    The driver holds the pivots (MOST_PIVOTS at most) with a size and radius each.
    """
    boosted = list(boosted)
    columns = ["id", "vec"] + ["category"] * bool(boosted)
    index = corpus if isinstance(corpus, PivotIndex) else PivotIndex(_fresh(corpus.select(*columns)), metric, block_rows)
    queries = cut_lineage(queries.select(*columns))
    schema = _result(queries, index.placed, [])
    kernel = _vector_kernel([], metric, k, digits, exclude_self, None, boosted, boost)
    if not index.rows:
        nothing = queries.limit(0).crossJoin(index.placed.limit(0).select(F.col("id").alias("c"))).select(
            F.col("id").alias("q_id"), F.col("c").alias("c_id"), F.lit(0.0).alias("score"))
        return _merge(nothing, [], k, names)
    factor = 1.0 + max(boost, 0.0) if boosted else 1.0
    near = cut_lineage(_compared(
        index.first_visits(queries, k + exclude_self, digits, factor), index.placed, index.size, index.block_rows, kernel, schema))
    reached = _merge(near, [], k, ("id", "c", "cut")).where(F.col("place") == k).select("id", "cut")
    open_ = cut_lineage(queries.join(reached, "id", "left"))
    if not _few(index.later_visits(open_, k + exclude_self, digits, factor, count=True), open_.count(), len(index.pivots)):
        return nearest_vectors(queries, index.placed, k, metric, exclude_self=exclude_self, boosted=boosted, boost=boost, digits=digits, names=names)
    far = _compared(
        index.later_visits(open_, k + exclude_self, digits, factor).drop("cut"), index.placed, index.size, index.block_rows, kernel, schema)
    return _merge(near.unionByName(far), [], k, names)


def nearest_exact(queries: DataFrame, corpus: DataFrame, k: int, rows: int, block_rows: int = BLOCK_ROWS, **kw) -> DataFrame:
    """nearest_pruned() for a corpus of more ``rows`` than one block holds, else nearest_vectors(): the rows are the same."""
    if rows > block_rows:
        return nearest_pruned(queries, corpus, k, block_rows=block_rows, **kw)
    return nearest_vectors(queries, corpus, k, **kw)


def _ranges(batch: pa.RecordBatch, pivots: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner of each cut, cuts, least, greatest distance of each query to each block)."""
    d = _distances(_points(pa.chunked_array([batch["vec"]]), batch.num_rows, "euclid"), pivots)
    cuts = batch["cuts"].to_pylist()
    owner = np.repeat(np.arange(batch.num_rows), [len(c) for c in cuts])
    return owner, np.array([x for c in cuts for x in c], np.float64), d - radius, d + radius


def count_better_pruned(queries: DataFrame, corpus: DataFrame, digits: int = 6, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of count_better() for the Euclidean metric; a block is scored only where some cut falls inside its range.

    A block that is nearer than a cut as a whole counts with its size, one that is farther counts nothing.
    """
    index = PivotIndex(_fresh(corpus.select("id", "vec")), "euclid", block_rows)
    queries = cut_lineage(queries.select("id", "vec", "cuts"))
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    slack = 10.0**-digits + _SLACK
    pivots, radius, size = index.pivots, index.radius, index.size

    def decided(owner, cuts, low, high):
        """(cut x block) all rows better, and (query x block) some cut undecided."""
        far = -cuts[:, None]
        all_better = high[owner] + slack < far
        open_ = ~all_better & (low[owner] - slack <= far) & (size > 0)
        some = np.zeros(low.shape, bool)
        np.logical_or.at(some, owner, open_)
        return all_better, some

    def ask(batch: pa.RecordBatch) -> np.ndarray:
        return decided(*_ranges(batch, pivots, radius))[1]

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 16 * len(pivots)):  # a query has several cuts
            owner, cuts, low, high = _ranges(batch, pivots, radius)
            all_better, some = decided(owner, cuts, low, high)
            n = ((all_better & ~some[owner]) * size).sum(axis=1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(owner)), pa.array(cuts), pa.array(n)], ["id", "cut", "better"])

    out = f"id {kinds['id']}, cut double, better bigint"
    if not _few(_visited(queries, ask, len(pivots), count=True), queries.count(), len(pivots)):
        return count_better(queries, index.placed, "euclid", digits)
    scored = _compared(_visited(queries, ask, len(pivots)), index.placed, index.size, block_rows, _count_kernel("euclid", digits), out)
    return queries.mapInArrow(base, out).unionByName(scored).groupBy("id", "cut").agg(F.sum("better").alias("better"))


_LABELS = 4096  # labels of one corpus row that travel together


def _label_kernel(metric: str, floor: float, digits: int):
    """Task of one cell: the distinct labels of the corpus rows that score ``floor`` or more for each query."""

    def kernel(ql: pa.Table, cl: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        labels = cl.column("labels").combine_chunks()
        flat = labels.flatten()
        found_q, found_l = [none], [none]
        if ql.num_rows and cl.num_rows:
            values, code = np.unique(flat.to_numpy(zero_copy_only=False), return_inverse=True)
            size = np.diff(labels.offsets.to_numpy())
            first = np.cumsum(size) - size
            qm, cm = _points(ql.column("vec"), ql.num_rows, metric), _points(cl.column("vec"), cl.num_rows, metric)
            step = max(1, TILE_CELLS // cl.num_rows)
            for lo in range(0, ql.num_rows, step):
                hit = np.round(_compare(metric, qm[lo : lo + step], cm), digits) >= floor
                weight = hit @ size
                at = 0
                while at < len(hit):  # rows whose labels are laid out together
                    end = max(at + 1, int(np.searchsorted(np.cumsum(weight), (np.cumsum(weight)[at - 1] if at else 0) + EXPANSION, "right")))
                    r, c = np.nonzero(hit[at:end])
                    n = size[c]
                    place = np.repeat(first[c] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    pair = np.unique(np.repeat(r, n) * max(1, len(values)) + code[place])
                    found_q.append(lo + at + pair // max(1, len(values)))
                    found_l.append(pair % max(1, len(values)))
                    at = end
        q, which = np.concatenate(found_q), np.concatenate(found_l)
        out = pa.array(values[which], flat.type) if len(which) else flat.slice(0, 0)
        return pa.table([ql.column("id").take(pa.array(q)), out], names=["q_id", "label"])

    return kernel


def labels_above(
    queries: DataFrame, corpus: DataFrame, labels: DataFrame, floor: float, metric: str = "cosine", digits: int = 6, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Distinct (q_id, label) of the corpus rows that score ``floor`` or more; the pairs stay in their cells.

    ``queries`` and ``corpus`` (id, vec), ``labels`` (id, label: whole numbers) of the corpus. Rows without labels are left out, and
    a row with very many is compared once for each slice of them. Blocks that lie beyond the floor are
    skipped.
    """
    labels = labels.select("id", "label").where(F.col("label").isNotNull()).distinct()
    n = labels.groupBy("id").agg(F.count("*").alias("n"))
    slices = labels.join(n, "id").groupBy("id", F.pmod(F.xxhash64("label"), F.ceil(F.col("n") / _LABELS)).alias("slice")).agg(F.collect_list("label").alias("labels"))
    rows = _fresh(corpus.select("id", "vec").join(slices.drop("slice"), "id"))
    index = PivotIndex(rows, metric, block_rows)
    kinds = {f.name: f.dataType for f in index.placed.schema}
    schema = f"q_id {queries.schema['id'].dataType.simpleString()}, label {kinds['labels'].elementType.simpleString()}"
    if not index.rows:
        return queries.limit(0).select(F.col("id").alias("q_id"), F.lit(None).cast(kinds["labels"].elementType).alias("label"))
    kernel = _label_kernel(metric, floor, digits)
    points = cut_lineage(queries.select("id", "vec", F.lit(float(floor)).alias("cut")))
    if _few(index.later_visits(points, 0, digits, count=True), points.count(), len(index.pivots)):
        asked = cut_lineage(index.later_visits(points, 0, digits).drop("cut"))
        found = _compared(asked, index.placed, index.size, index.block_rows, kernel, schema)
    else:
        left, right = _placed(points.drop("cut"), index.placed.drop("pivot", "away"), [])
        found = left.groupBy("q_block", "c_block").cogroup(right.groupBy("q_block", "c_block")).applyInArrow(kernel, schema)
    return found.distinct()  # slices and cells of one query may hold a label each
