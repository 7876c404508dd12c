"""R: prediction reports over the ranked, tiered rows of all contexts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(top: DataFrame, contexts: DataFrame, items: DataFrame) -> DataFrame:
    c = contexts.select("context", F.col("name").alias("context_name"), "category")
    i = items.select("item", F.col("name").alias("item_name"), F.col("class1").alias("code"))
    return top.join(c, "context").join(i, "item")


def share_by(df: DataFrame, key: str) -> DataFrame:
    """Counts and percent per value."""
    total = df.agg(F.count("*").alias("__t"))
    return df.groupBy(key).agg(F.count("*").alias("n")).join(F.broadcast(total)).select(key, "n", F.round(F.col("n") * 100 / F.col("__t"), 4).alias("pct"))


def precision_lookup(category: Column, tier: Column, by_category: Mapping[str, float], by_tier: Mapping[str, float], tier_name: str = "MEDIUM") -> Column:
    """The category's value inside one tier, else the default of the tier, else 0."""
    out = None
    for c, v in by_category.items():
        hit = (tier == tier_name) & (category == c)
        out = F.when(hit, v) if out is None else out.when(hit, v)
    for name, v in by_tier.items():
        out = F.when(tier == name, v) if out is None else out.when(tier == name, v)
    return out.otherwise(0.0)


def of_contexts(predictions: DataFrame, *names: str, include_filtered: bool = False) -> DataFrame:
    """Rows of the named contexts; Spark pushes the filter below the rules."""
    out = predictions.where(F.col("context_name").isin(*[n.lower() for n in names]))
    return out if include_filtered else out.where(F.col("tier") != "FILTER")


def novel_rows(df: DataFrame, tiers: Sequence[str], withdrawn: str) -> DataFrame:
    """Tier high enough, not known, not excluded, not withdrawn."""
    return df.where(F.col("tier").isin(*tiers) & ~F.col("known") & (F.col("level") != "EXCLUDED") & ~F.col("item_name").rlike(withdrawn))


def truth_completeness(known: DataFrame, expanded: DataFrame) -> DataFrame:
    """Known truth / expanded truth per context."""
    k = known.groupBy("context").agg(F.count("*").alias("known"))
    e = expanded.groupBy("context").agg(F.count("*").alias("expanded"))
    return e.join(k, "context", "left").select(
        "context", F.coalesce("known", F.lit(0)).alias("known"), "expanded", F.round(F.coalesce("known", F.lit(0)) / F.col("expanded"), 6).alias("completeness")
    )


def quality_quartile(translation: Column, mechanism: Column, rank: Column) -> Column:
    """R7."""
    return (
        F.when(translation & mechanism, F.lit("Q1")).when(translation | (mechanism & (rank <= 10)), F.lit("Q2"))
        .when(mechanism | (rank <= 10), F.lit("Q3")).otherwise(F.lit("Q4"))
    )


def priority(tier: Column, relevant: Column) -> Column:
    """R9."""
    return (
        F.when((tier == "GOLDEN") | ((tier == "HIGH") & relevant), 1)
        .when((tier == "HIGH") | ((tier == "MEDIUM") & relevant), 2).otherwise(3)
    )


def result_summary(df: DataFrame) -> DataFrame:
    """Counts and means per context and tier."""
    return df.groupBy("context", "tier").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("mean_score"), F.min("rank").alias("best_rank"), F.count_if("mechanism").alias("n_mechanism")
    )


def work_status(log: DataFrame, status: str, order: Sequence[str], key: str) -> DataFrame:
    """Rows per status and the next one in line."""
    return log.groupBy(status).agg(F.count("*").alias("n"), F.min_by(key, F.struct(*order)).alias("next_id"))
