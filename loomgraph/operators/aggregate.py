"""A: statistics of neighbours, scores, ranks and groups; plain aggregates that combine on the map side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequency(truth: DataFrame) -> DataFrame:
    """A1."""
    return truth.groupBy("item").agg(F.count("*").alias("train_frequency"))


def neighbour_statistics(neighbours: DataFrame, truth: DataFrame, votes: DataFrame | None = None) -> DataFrame:
    """A2: similarity statistics of the k neighbours and, where ``votes`` are given, the size of the pool they open."""
    sizes = truth.groupBy(F.col("context").alias("neighbour")).agg(F.count("*").alias("n_items"))
    s = F.col("similarity")
    stats = neighbours.join(sizes, "neighbour", "left").groupBy("context").agg(
        F.round(F.avg(s), 9).alias("mean_similarity"), F.max(s).alias("max_similarity"), F.min(s).alias("min_similarity"),
        F.round(F.stddev_pop(s), 6).alias("std_similarity"), F.count("n_items").alias("n_with_items"),
        F.round(F.avg("n_items"), 6).alias("mean_items"), F.max("n_items").alias("max_items"),
    )
    if votes is None:
        return stats
    pool = votes.groupBy("context").agg(F.count("*").alias("pool_size"))
    return stats.join(pool, "context", "left").withColumn("pool_size", F.coalesce("pool_size", F.lit(0)))


def score_distribution(ranked: DataFrame, digits: int = 6) -> DataFrame:
    """A4: margin, ratios, entropy, ties and dispersion of the scores of each context (score, rank)."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    marks = ranked.groupBy("context").agg(
        at(1).alias("s1"), at(20).alias("s20"), at(21).alias("s21"), at(30).alias("s30"),
        F.sum(F.when(F.col("rank") <= 30, F.col("score"))).alias("total"), F.countDistinct("score").alias("n_distinct"),
        F.avg(F.when(F.col("rank") <= 30, F.col("score"))).alias("mean30"), F.stddev_pop(F.when(F.col("rank") <= 30, F.col("score"))).alias("std30"),
    )
    p = F.col("score") / F.col("total")
    more = ranked.join(marks, "context").groupBy("context").agg(
        F.sum(F.when((F.col("rank") <= 30) & (F.col("total") > 0), -p * F.log(p + 1e-10))).alias("entropy"),
        F.count_if(F.col("score") == F.col("s20")).alias("ties_at_20"),
    )
    ratio = lambda a: F.when(F.col("s1") > 0, F.round(F.col(a) / F.col("s1"), digits))
    return marks.join(more, "context").select(
        "context", F.round(F.col("s20") - F.col("s21"), digits).alias("margin_20"), ratio("s20").alias("ratio_20"), ratio("s30").alias("ratio_30"),
        F.round("entropy", 4).alias("entropy"), "ties_at_20", "n_distinct",
        F.when(F.col("mean30") > 0, F.round(F.col("std30") / F.col("mean30"), digits)).alias("dispersion"),
    )


def rank_stability(ranks: DataFrame, by: Sequence[str], digits: int = 6) -> DataFrame:
    """Mean, spread and shares of the ranks per key."""
    r = F.col("rank")
    return ranks.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg(r), digits).alias("mean_rank"), F.round(F.stddev_pop(r), digits).alias("std_rank"),
        F.round(F.stddev_pop(r) / F.avg(r), digits).alias("cv"), F.min(r).alias("min_rank"), F.max(r).alias("max_rank"), (F.max(r) - F.min(r)).alias("spread"),
        F.round(F.avg((r <= 5).cast("double")), digits).alias("share_top5"), F.round(F.avg((r <= 10).cast("double")), digits).alias("share_top10"),
    )


def class_width(truth: DataFrame, classes: DataFrame) -> DataFrame:
    """Mean number of contexts per item of a class."""
    freq = frequency(truth)
    return classes.join(freq, "item").groupBy("cls").agg(F.count("*").alias("n_items"), F.round(F.avg("train_frequency"), 6).alias("width"))


def isolation_precision(predictions: DataFrame, classes: DataFrame) -> DataFrame:
    """Hits of predictions that stand alone in their class in the context, and of the others."""
    w = Window.partitionBy("context", "cls")
    tagged = predictions.join(classes, "item").withColumn("isolated", F.count("*").over(w) == 1)
    return precision_by(tagged, ["cls", "isolated"])


def precision_by(df: DataFrame, by: Sequence[str], hit: str = "hit", digits: int = 4) -> DataFrame:
    """Hits, rows and percent per group."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.col(hit).cast("bigint")).alias("hits"), F.round(F.avg(F.col(hit).cast("double")) * 100, digits).alias("precision_pct")
    )


def class_uniqueness(predictions: DataFrame, votes: DataFrame, neighbours: DataFrame, truth: DataFrame, classes: DataFrame) -> DataFrame:
    """Class-mates in the pool at two levels, breadth of the class and neighbours that hold the item."""
    pool = votes.join(classes, "item")
    one = pool.groupBy("context", "class1").agg(F.countDistinct("item").alias("n1"))
    two = pool.groupBy("context", "class2").agg(F.countDistinct("item").alias("n2"))
    breadth = classes.groupBy("class2").agg(F.countDistinct("item").alias("breadth"))
    known = truth.select(F.col("context").alias("neighbour"), "item")
    support = predictions.select("context", "item").join(neighbours.select("context", "neighbour"), "context").join(known, ["neighbour", "item"], "left_semi").groupBy("context", "item").agg(F.count("*").alias("support"))
    return (
        predictions.select("context", "item").join(classes, "item").join(one, ["context", "class1"]).join(two, ["context", "class2"])
        .join(breadth, "class2").join(support, ["context", "item"], "left")
        .select("context", "item", (F.col("n1") - 1).alias("mates1"), (F.col("n2") - 1).alias("mates2"), "breadth", F.coalesce("support", F.lit(0)).alias("support"))
    )


def crosstab(df: DataFrame, a: str, b: str, hit: str = "hit") -> DataFrame:
    """A10: cube of two keys with hits and precision; ALL marks the margins."""
    g = df.cube(a, b).agg(F.count("*").alias("n"), F.sum(F.col(hit).cast("bigint")).alias("hits"))
    return g.select(F.coalesce(a, F.lit("ALL")).alias(a), F.coalesce(b, F.lit("ALL")).alias(b), "n", "hits", F.round(F.col("hits") * 100 / F.col("n"), 4).alias("precision_pct"))


def self_reference(truth: DataFrame) -> DataFrame:
    """Share of a context's items that no other context has; island = more than 5 items and all of them."""
    lone = truth.join(frequency(truth), "item")
    share = F.round(F.avg((F.col("train_frequency") == 1).cast("double")) * 100, 4)
    return lone.groupBy("context").agg(F.count("*").alias("n_items"), share.alias("self_only_pct")).withColumn(
        "island", (F.col("n_items") > 5) & (F.col("self_only_pct") == 100)
    )


def error_profile(truth: DataFrame, ranked: DataFrame, item_kind: DataFrame, categories: DataFrame, top: int = 30) -> DataFrame:
    """Truth items that were missed, by kind of item, category and rank band."""
    r = F.col("rank")
    band = F.when(r.isNull(), F.lit("none")).when(r <= 50, F.lit("31-50")).when(r <= 100, F.lit("51-100")).otherwise(F.lit("101+"))
    return (
        truth.join(ranked.select("context", "item", "rank"), ["context", "item"], "left").where(r.isNull() | (r > top))
        .join(item_kind, "item").join(categories, "context").groupBy("kind", "category", band.alias("band")).agg(F.count("*").alias("missed"))
    )


def group_profile(df: DataFrame, flag: Column, measures: Sequence[str], digits: int = 6) -> DataFrame:
    """Mean of each measure in two groups and their difference, one row per measure."""
    yes, no = [F.avg(F.when(flag, F.col(m))) for m in measures], [F.avg(F.when(~flag, F.col(m))) for m in measures]
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"y{i}").alias("mean_yes"), F.col(f"n{i}").alias("mean_no")) for i, m in enumerate(measures)])
    one = df.agg(*[c.alias(f"y{i}") for i, c in enumerate(yes)], *[c.alias(f"n{i}") for i, c in enumerate(no)])
    return one.select(F.explode(rows).alias("r")).select(
        "r.measure", F.round("r.mean_yes", digits).alias("mean_yes"), F.round("r.mean_no", digits).alias("mean_no"),
        F.round(F.col("r.mean_yes") - F.col("r.mean_no"), digits).alias("difference"),
    )
