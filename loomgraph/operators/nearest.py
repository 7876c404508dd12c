"""Exact top-k similarity joins without emitting the pairs.

Both sides are hashed into blocks of bounded size and every pair of blocks meets in one
task (fragment and replicate).  A task multiplies its two blocks and keeps only the k best
partners per query, so what leaves it is ``queries x k`` rows and not ``queries x corpus``;
a final window merges the partial lists.  Ids are hashed, so a feature or category that a
third of all rows share does not change the size of a task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import cut_lineage

BLOCK_ROWS = 8192
BLOCK_CELLS = 2**22  # numbers in a block of vectors: 65536 rows of 64
TILE_CELLS = 4_000_000
EXPANSION = 8_000_000
SET_ROWS = 2**20  # most sets, and about the members, of a block of sets
BLOCK_MEMBERS = 2**24
SET_EXPANSION = 1_000_000
MASK_TILE = 2**15  # sets whose bits are compared at once


def _best_in_tile(scores: np.ndarray, k: int, floor: float | None):
    """(row, column) of the k best per row, ties to the lower column."""
    if scores.shape[1] > k:
        cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        keep = scores >= cut
    else:
        keep = np.ones(scores.shape, dtype=bool)
    if floor is not None:
        keep &= scores >= floor
    keep &= scores > -np.inf
    rows, cols = np.nonzero(keep)
    order = np.lexsort((cols, -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, rows, side="left")
    best = (np.arange(len(rows)) - first) < k
    return rows[best], cols[best]


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _numpy(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _compare(metric: str, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    if metric == "cosine":
        return q @ c.T
    if metric == "dot":
        return q @ c.T
    sq = (q * q).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2.0 * (q @ c.T)
    return -np.sqrt(np.maximum(sq, 0.0))


def _fresh(df: DataFrame) -> DataFrame:
    """New column ids, so that a table can meet itself."""
    return df.toDF(*df.columns)


def _blocks(size: str, spread: int):
    """Number of blocks of a side of ``size`` (n, blocks): bounded block size, and some spread for small tables."""
    n = F.col(f"{size}.n")
    return F.greatest(F.ceil(F.col(f"{size}.blocks")), F.least(F.lit(spread), F.ceil(n / 64)), F.lit(1)).cast("int")


def _placed(left: DataFrame, right: DataFrame, by: list[str], rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Give both sides the cells (q_block, c_block) of their group's grid.

    A block holds ``rows`` vectors, or BLOCK_CELLS numbers: a vector is sent once for each block of the other side.

    The grid of a group follows from its own two sizes, so a group that holds a third of all
    rows is split into many cells while small groups stay one cell.
    """
    whole = not by
    n_ids = F.struct(F.count("*").alias("n"), (F.count("*") / rows if rows else F.sum(F.size("vec")) / BLOCK_CELLS).alias("blocks"))
    if whole:
        left, right = left.withColumn("__all", F.lit(0)), right.withColumn("__all", F.lit(0))
    keys = ["__all"] if whole else by
    spread = left.sparkSession.sparkContext.defaultParallelism if whole else 1
    sizes = (
        left.groupBy(*keys).agg(n_ids.alias("n_q"))
        .join(right.groupBy(*keys).agg(n_ids.alias("n_c")), keys)
        .select(*keys, _blocks("n_q", spread).alias("n_q"), _blocks("n_c", 1).alias("n_c"))
    )
    sizes = F.broadcast(sizes) if whole else sizes

    def cells(df: DataFrame, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        return (
            df.join(sizes, keys)
            .withColumn(own, F.pmod(F.xxhash64("id"), F.col(n_own)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)))
            .drop("n_q", "n_c", "__all")
        )

    return cells(left, "q_block", "n_q", "c_block", "n_c"), cells(right, "c_block", "n_c", "q_block", "n_q")


def _merge(parts: DataFrame, by: Sequence[str], k: int, names: tuple[str, str, str], then: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    q, n, s = names
    w = Window.partitionBy(*by, "q_id").orderBy(F.col("score").desc(), *then, F.col("c_id"))
    return (
        parts.withColumn("place", F.row_number().over(w))
        .where(F.col("place") <= k)
        .select(*by, F.col("q_id").alias(q), F.col("c_id").alias(n), F.col("score").alias(s), *then, *keep, "place")
    )


def _vector_kernel(by, metric: str, k: int, digits: int, exclude_self: bool, floor: float | None, boosted, boost: float, draws: int = 0):
    """Task of one cell: the k best corpus rows of each query row, per draw where ``draws`` are given.

    With draws a corpus row holds a bit mask ``draws`` of those that it takes part in, and a result row the
    mask of those in which it is among the k best.
    """

    def kernel(ql: pa.Table, cl: pa.Table) -> pa.Table:
        schema_names = [*by, "q_id", "c_id", "score"] + ["draws"] * bool(draws)
        if ql.num_rows == 0 or cl.num_rows == 0:
            arrays = [ql.column(b).slice(0, 0) for b in by] + [ql.column("id").slice(0, 0), cl.column("id").slice(0, 0), pa.array([], pa.float64())]
            return pa.table(arrays + [pa.array([], pa.int64())] * bool(draws), names=schema_names)
        order = pa.compute.sort_indices(cl.column("id"))
        cl = cl.take(order)
        qm, cm = _matrix(ql.column("vec"), ql.num_rows), _matrix(cl.column("vec"), cl.num_rows)
        if metric == "cosine":
            qm, cm = _unit(qm), _unit(cm)
        q_ids, c_ids = _numpy(ql, "id"), _numpy(cl, "id")
        takes = [(_numpy(cl, "draws") >> d & 1).astype(bool) for d in range(draws)]
        if boosted:
            q_cat = np.asarray(ql.column("category").to_pylist(), dtype=object)
            c_cat = np.asarray(cl.column("category").to_pylist(), dtype=object)
            is_boosted = np.isin(q_cat.astype(str), boosted)
        step = max(1, TILE_CELLS // max(1, len(c_ids)))
        found_q, found_c, found_s, found_d = [], [], [], []
        for lo in range(0, len(q_ids), step):
            rows = slice(lo, lo + step)
            scores = _compare(metric, qm[rows], cm)
            if boosted:
                same = (q_cat[rows][:, None] == c_cat[None, :]) & is_boosted[rows][:, None]
                scores = np.where(same, scores * (1.0 + boost), scores)
            scores = np.round(scores, digits) + 0.0
            if exclude_self:
                scores[q_ids[rows][:, None] == c_ids[None, :]] = -np.inf
            if draws:
                r, c, mask = _best_by_draw(scores, k, takes)
                found_d.append(mask)
            else:
                r, c = _best_in_tile(scores, k, floor)
            found_q.append(r + lo)
            found_c.append(c)
            found_s.append(scores[r, c])
        r, c = np.concatenate(found_q), np.concatenate(found_c)
        arrays = [ql.column(b).take(pa.array(np.zeros(len(r), dtype=np.int64))) for b in by]
        arrays += [ql.column("id").take(pa.array(r)), cl.column("id").take(pa.array(c))]
        arrays.append(pa.array(np.concatenate(found_s), pa.float64()))
        return pa.table(arrays + ([pa.array(np.concatenate(found_d), pa.int64())] if draws else []), names=schema_names)

    return kernel


def _best_by_draw(scores: np.ndarray, k: int, takes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, mask of draws): the k best per row among the columns of each draw, ties to the lower column.

    Rows are sorted once, as far down as every draw has k columns; the few rows that need more are sorted whole.
    """
    n = scores.shape[1]
    least = min((t.mean() for t in takes), default=1.0)
    ahead = min(n, int(2 * k / max(least, 1e-9)) + 16)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    open_ = np.arange(len(scores))
    while len(open_):
        part = scores[open_]
        if ahead < n:
            place = np.sort(np.argpartition(-part, ahead, axis=1)[:, :ahead], axis=1)
            cut = np.partition(-part, ahead, axis=1)[:, ahead : ahead + 1]  # the best score that is left out
            best = np.take_along_axis(part, place, 1)
        else:
            place, best, cut = np.broadcast_to(np.arange(n), part.shape), part, np.inf
        order = np.argsort(-best, axis=1, kind="stable")
        best, place = np.take_along_axis(best, order, 1), np.take_along_axis(place, order, 1)
        live = (best > -np.inf) & (-best < cut)  # ties with what is left out are undecided
        masks = np.zeros(order.shape, np.int64)
        whole = np.ones(len(open_), bool)
        for d, take in enumerate(takes):
            mine = take[place] & live
            count = np.cumsum(mine, axis=1)
            masks |= (mine & (count <= k)).astype(np.int64) << d
            whole &= count[:, -1] >= min(k, int(take.sum()))
        if ahead == n:
            whole[:] = True
        r, c = np.nonzero((masks > 0) & whole[:, None])
        out.append((open_[r], place[r, c], masks[r, c]))
        open_, ahead = open_[~whole], n
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def nearest_vectors(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    metric: str = "cosine",
    by: Sequence[str] = (),
    exclude_self: bool = False,
    boosted: Sequence[str] = (),
    boost: float = 0.5,
    floor: float | None = None,
    digits: int = 6,
    names: tuple[str, str, str] = ("context", "neighbour", "similarity"),
    block_rows: int | None = None,
) -> DataFrame:
    """K1 + K2 (+ K4): the k most similar corpus rows of every query.

    ``queries`` and ``corpus`` hold ``id``, ``vec`` (array<float|double>), the columns of
    ``by`` (only equal groups meet) and, for a category boost, ``category``.  Scores are
    rounded to ``digits`` before the cut; equal scores go to the lower id.  Every pair is compared;
    nearest_pruned() leaves out blocks that can hold none of the best.
    """
    by, boosted = list(by), list(boosted)
    extra = ["category"] if boosted else []
    queries = queries.select("id", "vec", *by, *extra)
    corpus = _fresh(corpus.select("id", "vec", *by, *extra))
    left, right = _placed(queries, corpus, by, block_rows)
    keys = [*by, "q_block", "c_block"]
    kernel = _vector_kernel(by, metric, k, digits, exclude_self, floor, boosted, boost)
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(kernel, _result(queries, corpus, by))
    return _merge(parts, by, k, names)


def _result(queries: DataFrame, corpus: DataFrame, by: Sequence[str], draws: int = 0) -> str:
    q, c = ({f.name: f.dataType.simpleString() for f in df.schema} for df in (queries, corpus))
    return ", ".join([f"{b} {q[b]}" for b in by] + [f"q_id {q['id']}", f"c_id {c['id']}", "score double"] + ["draws bigint"] * bool(draws))


def nearest_by_draw(
    queries: DataFrame, corpus: DataFrame, k: int, draws: int, metric: str = "cosine", exclude_self: bool = False, digits: int = 6, block_rows: int | None = None,
) -> DataFrame:
    """The k best corpus rows of every query in each of up to 63 draws, in one pass over the pairs.

    ``corpus`` (id, vec, draws: bit mask of the draws that a row is in). Returns (q_id, c_id, score, draws):
    one row per neighbour, with the mask of the draws in which it is among the k best.
    """
    queries, corpus = queries.select("id", "vec"), _fresh(corpus.select("id", "vec", "draws"))
    left, right = _placed(queries, corpus, [], block_rows)
    keys = ["q_block", "c_block"]
    kernel = _vector_kernel([], metric, k, digits, exclude_self, None, [], 0.0, draws)
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(kernel, _result(queries, corpus, [], draws))
    # cells of one query meet again: per draw the k best of their lists
    single = parts.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).where(F.expr("shiftright(draws, bit) & 1") == 1)
    w = Window.partitionBy("q_id", "bit").orderBy(F.col("score").desc(), "c_id")
    return (
        single.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
        .groupBy("q_id", "c_id").agg(F.max("score").alias("score"), F.sum(F.expr("shiftleft(1L, bit)")).alias("draws"))
    )


def _packed_sets(sets: DataFrame, by: list[str]) -> DataFrame:
    """Long rows (id, feature) as one row a set (id, features: sorted), written once; whole numbers that fit travel as int.

    Rows may repeat. As collect_set() drops repeats, Spark leaves out a distinct before it, and the rows travel once.
    """
    packed = cut_lineage(sets.groupBy(*by, "id").agg(F.sort_array(F.collect_set("feature")).alias("features")))
    if packed.schema["features"].dataType.elementType.typeName() == "long":
        wide = packed.agg(F.max(F.greatest(F.abs(F.element_at("features", 1)), F.abs(F.element_at("features", -1))))).head()[0]
        if wide is None or wide < 2**31:
            packed = packed.withColumn("features", F.col("features").cast("array<int>"))
    return packed


def _set_cells(left: DataFrame, right: DataFrame, by: list[str], rows: int) -> tuple[DataFrame, DataFrame]:
    """Cells of packed sets: a block holds at most ``rows`` sets and about BLOCK_MEMBERS of their members.

    A set is sent once for each block of the other side, so few large blocks keep the shuffle small.
    """
    keys, spread = by, 1
    if not by:
        left, right = left.withColumn("__all", F.lit(0)), right.withColumn("__all", F.lit(0))
        keys, spread = ["__all"], left.sparkSession.sparkContext.defaultParallelism
    size = lambda df, own, least: df.groupBy(*keys).agg(
        F.greatest(F.ceil(F.sum(F.size("features")) / BLOCK_MEMBERS), F.ceil(F.count("*") / rows), F.least(F.lit(least), F.ceil(F.count("*") / 64)), F.lit(1)).cast("int").alias(own))
    grid = size(left, "n_q", spread).join(size(right, "n_c", 1), keys)
    grid = grid if by else F.broadcast(grid)

    def cells(df: DataFrame, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        return (
            df.join(grid, keys).withColumn(own, F.pmod(F.xxhash64("id"), F.col(n_own)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).drop("n_q", "n_c", "__all")
        )

    return cells(left, "q_block", "n_q", "c_block", "n_c"), cells(right, "c_block", "n_c", "q_block", "n_q")


class _Postings:
    """The corpus sets of a cell by feature: ``row[first[i] : first[i + 1]]`` are the sets that hold ``feature[i]``, ascending."""

    def __init__(self, sizes: np.ndarray, members: np.ndarray):
        order = np.argsort(members, kind="stable")
        self.row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        members = members[order]
        new = np.flatnonzero(np.concatenate(([True], members[1:] != members[:-1]))) if len(members) else np.zeros(0, np.int64)
        self.feature, self.first = members[new], np.append(new, len(members))

    def ranges(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place and number of the sets that hold each wanted feature."""
        if not len(self.feature):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(self.feature, wanted), len(self.feature) - 1)
        first = self.first[at]
        return first, np.where(self.feature[at] == wanted, self.first[at + 1] - first, 0)

    def total(self, wanted: np.ndarray) -> int:
        """How many rows the ranges of all wanted features have."""
        return sum(int(self.ranges(wanted[at : at + SET_EXPANSION])[1].sum()) for at in range(0, len(wanted), SET_EXPANSION))


def _laid_out(first: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The places of all ranges one after the other."""
    return np.arange(int(width.sum())) + np.repeat(first - (np.cumsum(width) - width), width)


def _shared_counts(row, first, width, sets: _Postings, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, set, number of shared features) of the pairs of ``n`` query rows that share any, in this order.

    Only sets that share something are visited. Where they lie close together they are counted in one
    array, else by sorting; a row with very many is laid out a part at a time.
    """
    some = width > 0
    row, first, width = row[some], first[some], width[some]
    if not len(row):
        return (np.zeros(0, np.int64),) * 3
    low = int(sets.row[first].min())
    span = int(sets.row[first + width - 1].max()) + 1 - low
    ends = np.cumsum(width)
    if n == 1 or n * span <= 4 * int(ends[-1]):
        both, at = np.zeros(n * span, np.int64), 0
        while at < len(width):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SET_EXPANSION, side="right")))
            w = width[at:to]
            both += np.bincount(np.repeat(row[at:to] * span - low, w) + sets.row[_laid_out(first[at:to], w)], minlength=n * span)
            at = to
        pair = np.flatnonzero(both)
        return pair // span, pair % span + low, both[pair]
    pair = np.sort(np.repeat(row * span - low, width) + sets.row[_laid_out(first, width)])
    new = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    return pair[new] // span, pair[new] % span + low, np.diff(np.append(new, len(pair)))


def _masks(owner: np.ndarray, members: np.ndarray, names: np.ndarray, n: int) -> np.ndarray:
    """Sets as bits, (words, n): bit i of a set is feature ``names[i]``; members that aren't named are left out."""
    at = np.minimum(np.searchsorted(names, members), len(names) - 1)
    held = names[at] == members
    out = np.zeros(((len(names) + 63) // 64, n), dtype=np.uint64)
    np.bitwise_or.at(out, (at[held] // 64, owner[held]), np.uint64(1) << (at[held] % 64).astype(np.uint64))
    return out


def _best_by_masks(q: np.ndarray, c: np.ndarray, c_size: np.ndarray, k: int):
    """(row, corpus rows, shared) of the k corpus sets that share most with each query set; ties to the earlier row.

    The corpus is met from its largest sets on, a tile at a time, as far as a set can still share as much as the k-th best.
    """
    if len(c) == 1 and not (c >> np.uint64(32)).any():
        q, c = q.astype(np.uint32), c.astype(np.uint32)
    order = np.argsort(-c_size, kind="stable")
    tiles, lo, width = [], 0, min(512, MASK_TILE)
    while lo < len(order):  # small ones first: they tell how much a set must share
        rows = order[lo : lo + width]
        tiles.append((rows, np.ascontiguousarray(c[:, rows]), int(c_size[rows[0]])))
        lo, width = lo + width, min(4 * width, MASK_TILE)
    for row in range(q.shape[1]):
        best, both, least, last = np.zeros(0, np.int64), np.zeros(0, np.int64), 1, len(order)
        for rows, masks, most in tiles:
            if most < least:
                break
            n = np.bitwise_count(masks[0] & q[0, row])
            for word in range(1, len(masks)):
                n = n.astype(np.int64) + np.bitwise_count(masks[word] & q[word, row])
            hit = np.flatnonzero(n >= least)
            here, shared = rows[hit], n[hit].astype(np.int64)
            if len(best) == k:
                new = (shared > least) | (here < last)
                here, shared = here[new], shared[new]
            if not len(here):
                continue
            best, both = np.append(best, here), np.append(both, shared)
            if len(best) >= k:
                enough = both >= np.partition(both, len(both) - k)[len(both) - k]
                best, both = best[enough], both[enough]
                first = np.lexsort((best, -both))[:k]
                best, both = best[first], both[first]
                least, last = int(both[-1]), int(best[-1])
        yield row, best, both


def _best_of_pairs(r: np.ndarray, c: np.ndarray, score: np.ndarray, n: int, k: int) -> np.ndarray:
    """Places of the k pairs of each of ``n`` rows with the best whole-number scores, ties to the lower c; pairs come by row, then c."""
    if not len(r):
        return r
    score = score - score.min()
    top = int(score.max()) + 1
    code = np.sort(r * top + score)
    end = np.cumsum(np.bincount(r, minlength=n))
    start = np.append(0, end[:-1])
    cut = np.where(end > start, code[np.minimum(np.maximum(start, end - k), len(code) - 1)] - np.arange(n) * top, 0)
    keep = np.flatnonzero(score >= cut[r])
    keep = keep[np.lexsort((c[keep], -score[keep], r[keep]))]
    rows = r[keep]
    return keep[np.arange(len(keep)) - np.searchsorted(rows, rows, side="left") < k]


def nearest_sets(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    metric: str = "jaccard",
    by: Sequence[str] = (),
    exclude_self: bool = False,
    min_score: float | None = None,
    digits: int = 6,
    names: tuple[str, str, str] = ("context", "neighbour", "similarity"),
    block_rows: int = SET_ROWS,
) -> DataFrame:
    """The k corpus sets that overlap most with every query set.

    Both sides are long tables ``(id, feature)``; repeated rows count once.  ``metric`` is
    ``overlap`` (number of shared features), ``jaccard`` or ``coverage`` (shared features, then
    the smaller corpus set; its ``size`` and that of the query set, ``listed``, are returned); pairs
    that share nothing are never reported.
    Scores are rounded half up.
    """
    by = list(by)
    left = _packed_sets(queries.select("id", "feature", *by), by)
    right = _fresh(left if corpus is queries else _packed_sets(corpus.select("id", "feature", *by), by))
    types = {f.name: f.dataType.simpleString() for f in left.schema}
    c_type = {f.name: f.dataType.simpleString() for f in right.schema}["id"]
    sized = metric == "coverage"
    out = ", ".join([f"{b} {types[b]}" for b in by] + [f"q_id {types['id']}", f"c_id {c_type}", "score double"] + ["size bigint", "listed bigint"] * sized)

    def kernel(ql: pa.Table, cl: pa.Table) -> pa.Table:
        schema_names = [*by, "q_id", "c_id", "score"] + ["size", "listed"] * sized
        ql, cl = (x.take(pa.compute.sort_indices(x.column("id"))) for x in (ql, cl))
        q_ids, c_ids = _numpy(ql, "id"), _numpy(cl, "id")
        q_size, c_size = (pa.compute.list_value_length(x.column("features")).to_numpy().astype(np.int64) for x in (ql, cl))
        members = pa.compute.list_flatten(ql.column("features")).to_numpy()
        sets = _Postings(c_size, pa.compute.list_flatten(cl.column("features")).to_numpy())
        sizes, by_size = np.unique(c_size, return_inverse=True)
        q_end = np.cumsum(q_size)
        none = np.zeros(0, np.int64)
        found_q, found_c, found_s = [none], [none], [np.zeros(0)]

        def compare(lo: int, n: int, row, first, width) -> None:
            r, c, both = _shared_counts(row, first, width, sets, n)
            if exclude_self:
                other = q_ids[lo + r] != c_ids[c]
                r, c, both = r[other], c[other], both[other]
            score, value = both, both.astype(np.float64)
            if metric == "jaccard":
                score = np.floor(both / (q_size[lo + r] + c_size[c] - both) * 10**digits + 0.5).astype(np.int64)
                value = score / 10**digits
            elif sized:  # the place of a size among those here, below one shared feature
                score = both * len(sizes) - by_size[c]
            if min_score is not None:
                enough = value >= min_score
                r, c, score, value = r[enough], c[enough], score[enough], value[enough]
            best = _best_of_pairs(r, c, score, n, k)
            found_q.append(lo + r[best])
            found_c.append(c[best])
            found_s.append(value[best])

        lo, words = 0, (len(sets.feature) + 63) // 64
        if metric == "overlap" and not exclude_self and min_score is None and sets.total(members) > len(q_ids) * len(c_ids) * words:
            # pairs share so much that comparing the bits of all is less work than going through what is shared
            masks = (_masks(np.repeat(np.arange(len(n)), n), m, sets.feature, len(n)) for n, m in ((q_size, members), (c_size, pa.compute.list_flatten(cl.column("features")).to_numpy())))
            for row, c, both in _best_by_masks(*masks, c_size, k):
                found_q.append(np.full(len(c), row, np.int64))
                found_c.append(c)
                found_s.append(both.astype(np.float64))
            lo = len(q_ids)
        while lo < len(q_ids):  # query rows whose ranges are looked up together, then those that are laid out together
            begin = int(q_end[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(q_end, begin + SET_EXPANSION // 4, side="right")))
            first, width = sets.ranges(members[begin : q_end[hi - 1]])
            row = np.repeat(np.arange(hi - lo), q_size[lo:hi])
            edge = np.append(0, q_end[lo:hi] - begin)
            work = np.append(0, np.cumsum(width))[edge]
            at = 0
            while at < hi - lo:
                to = max(at + 1, int(np.searchsorted(work, work[at] + SET_EXPANSION, side="right")) - 1)
                part = slice(edge[at], edge[to])
                compare(lo + at, to - at, row[part] - at, first[part], width[part])
                at = to
            lo = hi
        q, c = np.concatenate(found_q), np.concatenate(found_c)
        arrays = [ql.column(b).take(pa.array(np.zeros(len(q), dtype=np.int64))) for b in by]
        arrays += [ql.column("id").take(pa.array(q)), cl.column("id").take(pa.array(c)), pa.array(np.concatenate(found_s), pa.float64())]
        return pa.table(arrays + [pa.array(c_size[c], pa.int64()), pa.array(q_size[q], pa.int64())] * sized, names=schema_names)

    left, right = _set_cells(left, right, by, block_rows)
    keys = [*by, "q_block", "c_block"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(kernel, out)
    return _merge(parts, by, k, names, ["size"] * sized, ["listed"] * sized)


def _count_kernel(metric: str, digits: int):
    """Task of one cell: for each cut of each query the number of corpus rows that score above it."""

    def kernel(ql: pa.Table, cl: pa.Table) -> pa.Table:
        cuts = ql.column("cuts").to_pylist()
        owner = np.repeat(np.arange(ql.num_rows), [len(c) for c in cuts])
        flat = np.array([x for c in cuts for x in c], np.float64)
        better = np.zeros(len(flat), dtype=np.int64)
        if ql.num_rows and cl.num_rows:
            qm, cm = _matrix(ql.column("vec"), ql.num_rows), _matrix(cl.column("vec"), cl.num_rows)
            if metric == "cosine":
                qm, cm = _unit(qm), _unit(cm)
            step = max(1, TILE_CELLS // cl.num_rows)
            first = np.searchsorted(owner, np.arange(ql.num_rows + 1))
            for lo in range(0, ql.num_rows, step):
                scores = np.sort(np.round(_compare(metric, qm[lo : lo + step], cm), digits) + 0.0, axis=1)
                for row, line in enumerate(scores, lo):
                    a, b = first[row], first[row + 1]
                    better[a:b] = len(line) - np.searchsorted(line, flat[a:b], "right")
        return pa.table([ql.column("id").take(pa.array(owner)), pa.array(flat), pa.array(better)], names=["id", "cut", "better"])

    return kernel


def count_better(queries: DataFrame, corpus: DataFrame, metric: str = "euclid", digits: int = 6, block_rows: int | None = None) -> DataFrame:
    """(id, cut, better): number of corpus rows that score above each cut of each query; no pair leaves a task.

    ``queries`` (id, vec, cuts: array), ``corpus`` (id, vec); ids of the queries must be unique. A query row is
    scored once for all its cuts, which are found in the sorted scores.
    """
    left, right = _placed(queries.select("id", "vec", "cuts"), _fresh(corpus.select("id", "vec")), [], block_rows)
    id_type = {f.name: f.dataType.simpleString() for f in queries.schema}["id"]
    keys = ["q_block", "c_block"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_count_kernel(metric, digits), f"id {id_type}, cut double, better bigint")
    return parts.groupBy("id", "cut").agg(F.sum("better").alias("better"))
