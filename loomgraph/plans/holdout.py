"""Seeded hold-out experiments. The seed is a column, so all seeds are one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.hashing import seeded_hash
from loomgraph.operators.aggregate import precision_by
from loomgraph.operators.nearest import nearest_vectors
from loomgraph.operators.ranking import hash_position, top_n, tier_order
from loomgraph.operators.similar import vote
from loomgraph.session import cut_lineage

SEEDS = (42, 43, 44, 45, 46)


def split(contexts: DataFrame, seeds: Sequence[int] = SEEDS, share: float = 0.2) -> DataFrame:
    """(seed, context, test): per seed the first ``share`` of the contexts in hash order are test."""
    seeded = contexts.select("context").distinct().withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    placed = hash_position(seeded.withColumn("h", seeded_hash(F.col("seed"), F.col("context"))), "h", "context", ["seed"])
    return placed.select("seed", "context", (F.col("position") <= F.floor(F.col("group_size") * share)).alias("test"))


def train_truth(truth: DataFrame, parts: DataFrame) -> DataFrame:
    """The truth that a seed may see; every builder takes it instead of the whole truth."""
    return truth.join(parts.where("NOT test").select("seed", "context"), "context")


def holdout_predictions(vectors: DataFrame, truth: DataFrame, seeds: Sequence[int] = SEEDS, k: int = 20, top: int = 30) -> tuple[DataFrame, DataFrame]:
    """Ranked items of the test contexts from training contexts only, and the split itself."""
    usable = vectors.join(truth.select("context").distinct(), "context", "left_semi")
    parts = cut_lineage(split(usable, seeds))
    v = usable.select("context", "vec").join(parts, "context")
    points = lambda df: df.select(F.col("context").alias("id"), "vec", "seed")
    near = nearest_vectors(points(v.where("test")), points(v.where("NOT test")), k, by=["seed"])
    votes = vote(near, train_truth(truth, parts), by=["seed"])
    return top_n(votes, ["seed", "context"], "score", "item", top), parts


def with_hits(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    known = truth.select("context", "item", F.lit(1).alias("hit"))
    return ranked.join(known, ["context", "item"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def base_tier(rank: Column, freq: Column, mech: Column) -> Column:
    """P6 in its short form: (tier, rule) by rank, training frequency and mechanism."""
    rules = [
        ("FILTER", "rank_over_20", rank > 20), ("FILTER", "rare_no_mechanism", (freq <= 2) & ~mech), ("GOLDEN", "freq15_mechanism", (freq >= 15) & mech),
        ("GOLDEN", "rank5_freq10_mechanism", (rank <= 5) & (freq >= 10) & mech), ("HIGH", "freq10_mechanism", (freq >= 10) & mech), ("HIGH", "rank5_freq5", (rank <= 5) & (freq >= 5)),
        ("MEDIUM", "freq5_mechanism", (freq >= 5) & mech), ("MEDIUM", "freq10", freq >= 10),
    ]
    out = None
    for tier, name, cond in rules:
        value = F.struct(F.lit(tier).alias("tier"), F.lit(name).alias("rule"))
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(F.struct(F.lit("LOW").alias("tier"), F.lit("default").alias("rule")))


def tiered_holdout(ranked: DataFrame, truth_seen: DataFrame, item_features: DataFrame, context_features: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Tier and rule of ranked rows; the training frequency is counted per seed."""
    from loomgraph.operators.graph import pair_overlap

    by = list(by)
    freq = truth_seen.groupBy(*by, "item").agg(F.count("*").alias("train_frequency"))
    pairs = pair_overlap(ranked.select("context", "item").distinct(), item_features, context_features).select("context", "item", "overlap")
    df = ranked.join(pairs, ["context", "item"]).join(freq, [*by, "item"], "left").withColumn("train_frequency", F.coalesce("train_frequency", F.lit(0)))
    df = df.withColumn("mechanism", F.col("overlap") > 0)
    return df.withColumn("o", base_tier(F.col("rank"), F.col("train_frequency"), F.col("mechanism"))).select("*", "o.tier", "o.rule").drop("o")


def over_seeds(df: DataFrame, by: Sequence[str], measure: str, digits: int = 4) -> DataFrame:
    """Mean and population deviation of a per-seed measure."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_seeds"), F.round(F.avg(measure), digits).alias("mean"), F.round(F.stddev_pop(measure), digits).alias("std")
    )


def audit(full: DataFrame, held: DataFrame, min_n: int = 10) -> DataFrame:
    """Full-data precision against the hold-out mean per tier, with a verdict and the monotone check."""
    from pyspark.sql import Window

    per_seed = held.groupBy("seed", "tier").agg(F.count("*").alias("n"), (F.avg("hit") * 100).alias("p"))
    h = per_seed.groupBy("tier").agg(F.round(F.avg("p"), 4).alias("holdout_pct"), F.round(F.stddev_pop("p"), 4).alias("holdout_std"), F.round(F.avg("n"), 4).alias("holdout_n"))
    f = precision_by(full, ["tier"]).select("tier", F.col("n").alias("full_n"), F.col("precision_pct").alias("full_pct"))
    d = F.round(F.col("holdout_pct") - F.col("full_pct"), 4)
    status = (
        F.when(F.col("holdout_n") < min_n, F.lit("SMALL_N")).when(F.col("delta") < -15, F.lit("OVERFITTED"))
        .when(F.col("delta") >= -5, F.lit("GENUINE")).otherwise(F.lit("DEGRADED"))
    )
    order = Window.partitionBy(F.lit(0)).orderBy("o")  # five rows, one per tier
    return (
        f.join(h, "tier").withColumn("delta", d).withColumn("status", status).withColumn("o", tier_order(F.col("tier")))
        .withColumn("above", F.lag("holdout_pct").over(order))
        .withColumn("monotone", F.col("above").isNull() | (F.col("above") >= F.col("holdout_pct"))).drop("o", "above")
    )
