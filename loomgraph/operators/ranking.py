"""W: windows, top-k, quantiles and global ranks; U: set operations on rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import cut_lineage


def ranked(df: DataFrame, by: Sequence[str], score: str, tie: str, name: str = "rank") -> DataFrame:
    """Position by score descending, then id ascending."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn(name, F.row_number().over(w))


def top_n(df: DataFrame, by: Sequence[str], score: str, tie: str, n: int, name: str = "rank") -> DataFrame:
    """Spark prunes each map task to n rows per group before the shuffle."""
    return ranked(df, by, score, tie, name).where(F.col(name) <= n)


def share_of_best(df: DataFrame, by: Sequence[str], score: str, name: str = "norm_score") -> DataFrame:
    """Score divided by the best score of the group."""
    best = F.max(score).over(Window.partitionBy(*by))
    return df.withColumn(name, F.when(best > 0, F.col(score) / best).otherwise(F.lit(0.0)))


def bucketed(value: Column, bounds: Sequence[float], labels: Sequence[str]) -> Column:
    """First bucket whose upper bound is not below the value, else the last label."""
    out = None
    for bound, label in zip(bounds, labels):
        hit = value <= bound
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(labels[-1])) if len(labels) > len(bounds) else out


RANK_BOUNDS = (5, 10, 15, 20, 25, 30)
RANK_LABELS = ("1-5", "6-10", "11-15", "16-20", "21-25", "26-30")


def rank_bucket(rank: Column) -> Column:
    return bucketed(rank, RANK_BOUNDS, RANK_LABELS)


def best_row(df: DataFrame, by: Sequence[str], value: str, score: str, tie: str) -> DataFrame:
    """Whole best row per key by a max_by aggregate (combined on the map side)."""
    cols = [c for c in df.columns if c not in by]
    key = F.struct(F.col(score), (-F.col(tie)).alias("tie"))
    return df.groupBy(*by).agg(F.max_by(F.struct(*cols), key).alias("best")).select(*by, "best.*")


def tier_order(tier: Column, tiers: Sequence[str] = ("GOLDEN", "HIGH", "MEDIUM", "LOW", "FILTER")) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(t) for t in tiers]), tier), F.lit(0).cast("bigint")), F.lit(len(tiers) + 1).cast("bigint")) - 1


def tier_first_rank(df: DataFrame, by: Sequence[str], score: str, tie: str, name: str = "rank") -> DataFrame:
    """Re-rank by tier, then score, then id."""
    w = Window.partitionBy(*by).orderBy(tier_order(F.col("tier")), F.col(score).desc(), F.col(tie))
    return df.withColumn(name, F.row_number().over(w))


def halves(df: DataFrame, by: Sequence[str], score: str, tie: str) -> DataFrame:
    """Top and bottom half of each group; a group of one is all top."""
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.orderBy(F.col(score).desc(), F.col(tie)))
    n = F.count("*").over(w)
    return df.withColumn(
        "half", F.when((n == 1) | (place <= F.floor(n / 2)), F.lit("top")).otherwise(F.lit("bottom"))
    )


def global_position(
    df: DataFrame, order: Sequence[Column], within: Sequence[str] = (), weight: Column | None = None,
    name: str = "position", partitions: int | None = None,
) -> DataFrame:
    """Running sum of ``weight`` (1 = row number) in a total order over the whole table.

    The rows are range partitioned on the order, numbered inside each range, and shifted by
    the totals of the ranges before; no task sees more than its own range.
    """
    within = list(within)
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = weight is None
    weight = F.lit(1) if counted else weight
    keys = [F.col(w) for w in within] + list(order)
    placed = cut_lineage(
        df.withColumn("__w", weight.cast("double")).repartitionByRange(n, *keys).withColumn("__pid", F.spark_partition_id())
    )
    inside = Window.partitionBy("__pid", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*(within or [F.lit(0)])).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("__pid", *within).agg(F.sum("__w").alias("__t"))
    offsets = totals.withColumn("__off", F.coalesce(F.sum("__t").over(before), F.lit(0.0))).drop("__t")
    numbered = placed.withColumn("__run", F.sum("__w").over(inside))
    out = numbered.join(offsets, ["__pid", *within]).withColumn(name, F.col("__run") + F.col("__off"))
    if counted:
        out = out.withColumn(name, F.col(name).cast("bigint"))
    return out.drop("__w", "__pid", "__run", "__off")


def hash_position(df: DataFrame, hash_col: str, tie: str, within: Sequence[str] = (), name: str = "position") -> DataFrame:
    """Row number by a uniform 32-bit hash: one bucket per leading 12 bits, offsets from counts."""
    within = list(within)
    df = df.withColumn("__b", F.floor(F.col(hash_col) / F.lit(2**20)).cast("int"))
    sizes = df.groupBy(*within, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*(within or [F.lit(0)])).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(*(within or [F.lit(0)]))
    sizes = sizes.select(
        *within, "__b",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
        F.sum("__n").over(total).alias("group_size"),
    )
    inside = Window.partitionBy(*within, "__b").orderBy(hash_col, tie)
    return (
        df.withColumn("__r", F.row_number().over(inside))
        .join(sizes, [*within, "__b"])
        .withColumn(name, F.col("__r") + F.col("__off"))
        .drop("__b", "__r", "__off")
    )


def quantile_groups(df: DataFrame, order: Sequence[Column], n: int, name: str = "part") -> DataFrame:
    """W4 positional: ntile over the whole table from the global position and the row count."""
    total = df.agg(F.count("*").alias("__total"))
    pos = global_position(df, order, name="__pos").join(F.broadcast(total))
    size, rest = F.floor(F.col("__total") / n), F.col("__total") % n
    big = rest * (size + 1)
    at = F.col("__pos") - 1
    part = F.when(at < big, F.floor(at / (size + 1))).otherwise(rest + F.floor((at - big) / F.greatest(size, F.lit(1))))
    return pos.withColumn(name, (part + 1).cast("int")).drop("__pos", "__total")


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], name: str = "cuts") -> DataFrame:
    """One row with the interpolated quantiles of a whole column, read off at their global positions."""
    total = df.agg(F.count(value).alias("__n"))
    placed = global_position(df.select(value).where(F.col(value).isNotNull()), [F.col(value)], name="__pos").join(F.broadcast(total))
    spots = [(F.col("__n") - 1) * F.lit(float(s)) for s in shares]
    wanted = F.lit(False)
    for s in spots:
        wanted = wanted | (F.col("__pos") == F.floor(s) + 1) | (F.col("__pos") == F.ceil(s) + 1)
    at = lambda where: F.max(F.when(F.col("__pos") == where + 1, F.col(value)))
    low = [at(F.floor(s)) for s in spots]
    high = [at(F.ceil(s)) for s in spots]
    share = [F.max(s - F.floor(s)) for s in spots]
    return placed.where(wanted).agg(F.array(*[lo + (hi - lo) * w for lo, hi, w in zip(low, high, share)]).alias(name))


def quantile_cuts(df: DataFrame, value: str, shares: Sequence[float], name: str = "band") -> DataFrame:
    """W4 by value: band = number of quantiles below the value."""
    cuts = exact_quantiles(df, value, shares, "__cuts")
    return (
        df.join(F.broadcast(cuts))
        .withColumn(name, F.size(F.filter("__cuts", lambda c: c < F.col(value))))
        .drop("__cuts")
    )


def average_rank(df: DataFrame, value: str, within: Sequence[str] = (), name: str = "avg_rank") -> DataFrame:
    """Mid-ranks: counts per distinct value, then a running sum over the distinct values."""
    within = list(within)
    counts = df.groupBy(*within, value).agg(F.count("*").alias("__c"))
    runs = global_position(counts, [F.col(value)], within, F.col("__c"), name="__upto")
    ranks = runs.select(*within, value, (F.col("__upto") - (F.col("__c") - 1) / 2).alias(name))
    return df.join(ranks, [*within, value])


def trailing_run(df: DataFrame, by: Sequence[str], seq: str, breaks: Column, name: str = "run") -> DataFrame:
    """Rows after the last break, as two plain aggregates."""
    last = df.groupBy(*by).agg(F.max(F.when(breaks, F.col(seq))).alias("__last"))
    return (
        df.join(last, list(by))
        .groupBy(*by)
        .agg(F.count_if(F.col("__last").isNull() | (F.col(seq) > F.col("__last"))).alias(name))
    )


def rank_of_items(predictions: DataFrame, wanted: DataFrame, by: Sequence[str], item: str) -> DataFrame:
    """Rank of each wanted item; a miss ranks one below the list."""
    length = predictions.groupBy(*by).agg(F.count("*").alias("list_length"))
    return (
        wanted.join(predictions.select(*by, item, "rank"), [*by, item], "left")
        .join(length, list(by), "left")
        .withColumn("found", F.col("rank").isNotNull())
        .withColumn("rank", F.coalesce("rank", F.coalesce("list_length", F.lit(0)) + 1))
    )


def membership_changes(old: DataFrame, new: DataFrame, by: Sequence[str], item: str) -> DataFrame:
    """U4: promoted, demoted and kept members of two lists."""
    a = old.select(*by, item, F.lit(1).alias("in_old"))
    b = new.select(*by, item, F.lit(1).alias("in_new"))
    return (
        a.join(b, [*by, item], "full_outer")
        .groupBy(*by)
        .agg(
            F.count_if(F.col("in_old").isNull()).alias("promoted"),
            F.count_if(F.col("in_new").isNull()).alias("demoted"),
            F.count_if(F.col("in_old").isNotNull() & F.col("in_new").isNotNull()).alias("kept"),
        )
    )
