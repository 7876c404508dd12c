"""E and T: measures on ranked rows with hits, and statistics on result tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.hashing import HASH_SPACE, seeded_hash
from loomgraph.operators.aggregate import precision_by
from loomgraph.operators.ranking import average_rank, global_position, hash_position
from loomgraph.session import cut_lineage


def recall(hits: DataFrame, truth: DataFrame, contexts: DataFrame, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Micro (sum of hits / sum of truth) and macro (mean per context) recall over ``contexts`` (by.., context)."""
    by = list(by)
    sizes = truth.groupBy("context").agg(F.count("*").alias("size"))
    found = hits.groupBy(*by, "context").agg(F.sum("hit").alias("found"))
    per = contexts.select(*by, "context").distinct().join(sizes, "context").join(found, [*by, "context"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return per.groupBy(*by).agg(
        F.count("*").alias("n_contexts"), F.round(F.sum("found") / F.sum("size"), digits).alias("micro"), F.round(F.avg(F.col("found") / F.col("size")), digits).alias("macro")
    )


def precision_recall_at(hits: DataFrame, truth: DataFrame, ks: Sequence[int], by: Sequence[str] = ("seed",), digits: int = 6) -> DataFrame:
    """E5: hits/k and hits/truth per context, then mean, deviation and median per k."""
    sizes = truth.groupBy("context").agg(F.count("*").alias("size"))
    cut = hits.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    per = cut.groupBy(*by, "context", "k").agg(F.sum(F.when(F.col("rank") <= F.col("k"), F.col("hit")).otherwise(0)).alias("found")).join(sizes, "context")
    p, r = F.col("found") / F.col("k"), F.col("found") / F.col("size")
    return per.groupBy("k").agg(
        F.count("*").alias("n"), F.round(F.avg(p), digits).alias("precision"), F.round(F.stddev_pop(p), digits).alias("precision_std"),
        F.round(F.avg(r), digits).alias("recall"), F.round(F.stddev_pop(r), digits).alias("recall_std"), F.round(F.percentile(r, 0.5), digits).alias("recall_median"),
    )


def auc(scored: DataFrame, score: str, label: str, tie: Sequence[str], digits: int = 6) -> DataFrame:
    """AUROC by mid-ranks, AUPRC (average precision) and precision at 50% recall, over the whole table."""
    ranks = average_rank(scored.select(score, label), score)
    y = F.col(label)
    roc = ranks.agg(F.sum(y).alias("pos"), F.count("*").alias("n"), F.sum(F.when(y == 1, F.col("avg_rank"))).alias("r"))
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    auroc = F.round((F.col("r") - pos * (pos + 1) / 2) / (pos * neg), digits)
    order = [F.col(score).desc(), *[F.col(t) for t in tie]]
    placed = global_position(scored.select(score, label, *tie), order, name="place")
    positives = global_position(placed.where(y == 1), order, name="nth")
    prec = F.col("nth") / F.col("place")
    total = scored.agg(F.sum(y).alias("all_pos"))
    pr = positives.join(F.broadcast(total)).agg(
        F.round(F.avg(prec), digits).alias("auprc"),
        F.round(F.min_by(prec, F.when(F.col("nth") >= F.col("all_pos") * 0.5, F.col("nth"))), digits).alias("precision_at_50"),
    )
    return roc.select("n", "pos", auroc.alias("auroc")).join(F.broadcast(pr))


def calibration_bins(df: DataFrame, p: str, label: str, digits: int = 6) -> DataFrame:
    """Reliability in ten bins with the error of each bin."""
    b = F.least(F.floor(F.col(p) * 10), F.lit(9))
    return df.groupBy(b.alias("bin")).agg(
        F.count("*").alias("n"), F.round(F.avg(p), digits).alias("mean_p"), F.round(F.avg(label), digits).alias("rate"), F.round(F.abs(F.avg(p) - F.avg(label)), digits).alias("error")
    )


def calibration_scores(df: DataFrame, p: str, label: str, digits: int = 6) -> DataFrame:
    """Brier score and the unweighted mean error of the bins."""
    brier = df.agg(F.round(F.avg(F.pow(F.col(p) - F.col(label), 2)), digits).alias("brier"))
    b = F.least(F.floor(F.col(p) * 10), F.lit(9))
    ece = df.groupBy(b.alias("b")).agg(F.abs(F.avg(p) - F.avg(label)).alias("e")).agg(F.round(F.avg("e"), digits).alias("ece"))
    return brier.join(F.broadcast(ece))


def threshold_choice(sweep: DataFrame, min_precision: float) -> DataFrame:
    """Per use the threshold with most rows, best precision, or best precision * sqrt(n)."""
    ok = sweep.where(F.col("precision_pct") >= min_precision)
    t = F.col("threshold")
    best = lambda key, name: F.max_by(t, F.struct(key, (-t).alias("tie"))).alias(name)
    return ok.agg(
        best(F.col("n"), "most_rows"), best(F.col("precision_pct"), "best_precision"), best(F.round(F.col("precision_pct") * F.sqrt("n"), 6), "balanced"), F.count("*").alias("n_candidates")
    )


def rank_cutoffs(hits: DataFrame, by: str, bounds: Sequence[int] = (5, 10, 15, 20, 25, 30), min_precision: float = 12.0, min_n: int = 10) -> DataFrame:
    """Last rank bucket before the first one that is large enough but not precise enough."""
    hi = F.lit(bounds[-1])
    for b in reversed(bounds):
        hi = F.when(F.col("rank") <= b, b).otherwise(hi)
    stats = precision_by(hits.withColumn("hi", hi), [by, "hi"])
    fails = stats.groupBy(by).agg(F.min(F.when((F.col("n") >= min_n) & (F.col("precision_pct") < min_precision), F.col("hi"))).alias("first_fail"))
    good = (F.col("n") >= min_n) & (F.col("precision_pct") >= min_precision) & (F.col("first_fail").isNull() | (F.col("hi") < F.col("first_fail")))
    return stats.join(fails, by).groupBy(by).agg(F.coalesce(F.max(F.when(good, F.col("hi"))), F.lit(0)).alias("cutoff"))


def cost_metrics(at_k: DataFrame, base_rate: Column, cost: float = 100.0, digits: int = 4) -> DataFrame:
    """Cost per true positive against a random order."""
    mine, rand = cost / F.col("precision"), cost / base_rate
    return at_k.select("k", F.round(mine, digits).alias("cost_per_hit"), F.round(rand, digits).alias("random_cost"), F.round((1 - mine / rand) * 100, digits).alias("reduction_pct"))


def funnel(steps: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Distinct keys left after each step."""
    out = None
    for i, (name, df) in enumerate(steps):
        one = df.agg(F.countDistinct(key).alias("left")).select(F.lit(i).alias("step"), F.lit(name).alias("name"), "left")
        out = one if out is None else out.unionByName(one)
    return out


def circularity(truth: DataFrame, edges: DataFrame) -> DataFrame:
    """Contexts by the share of their truth that is also an edge."""
    flag = truth.join(edges.select("context", "item").distinct().withColumn("e", F.lit(1)), ["context", "item"], "left")
    per = flag.groupBy("context").agg(F.count("*").alias("n"), F.count("e").alias("m"))
    kind = F.when(F.col("m") == 0, F.lit("none")).when(F.col("m") == F.col("n"), F.lit("all")).otherwise(F.lit("mixed"))
    return per.groupBy(kind.alias("kind")).agg(F.count("*").alias("contexts"), F.sum("n").alias("pairs"), F.sum("m").alias("in_graph"))


def blocked_pairs(truth: DataFrame, ranked: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Truth pairs that were not predicted, with the number of neighbours that hold the item."""
    lost = truth.join(neighbours.select("context").distinct(), "context", "left_semi").join(ranked.select("context", "item"), ["context", "item"], "left_anti")
    known = truth.select(F.col("context").alias("neighbour"), "item")
    held = lost.join(neighbours.select("context", "neighbour"), "context").join(known, ["neighbour", "item"], "left_semi").groupBy("context", "item").agg(F.count("*").alias("holders"))
    return lost.join(held, ["context", "item"], "left").withColumn("holders", F.coalesce("holders", F.lit(0)))


def moved_rows(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per (old tier, new tier) with hits."""
    a = before.select(*keys, "hit", F.col("tier").alias("old_tier"))
    return precision_by(a.join(after.select(*keys, F.col("tier").alias("new_tier")), list(keys)), ["old_tier", "new_tier"])


def subgroup(hits: DataFrame, keep: Column, by: Sequence[str], min_seeds: int = 3, min_mean_n: float = 2.0) -> DataFrame:
    """Mean and deviation over seeds of the precision in a filtered subgroup."""
    per = hits.where(keep).groupBy(*by, "seed").agg(F.count("*").alias("n"), (F.avg("hit") * 100).alias("p"))
    out = per.groupBy(*by).agg(
        F.count("*").alias("n_seeds"), F.round(F.avg("n"), 4).alias("mean_n"), F.round(F.avg("p"), 4).alias("mean"), F.round(F.stddev_pop("p"), 4).alias("std")
    )
    return out.where((F.col("n_seeds") >= min_seeds) & (F.col("mean_n") >= min_mean_n))


def compare_models(a: DataFrame, b: DataFrame) -> DataFrame:
    """Contexts where the first model has more, fewer or equally many hits."""
    x = a.groupBy("context").agg(F.sum("hit").alias("h1"))
    y = b.groupBy("context").agg(F.sum("hit").alias("h2"))
    d = x.join(y, "context").withColumn("d", F.col("h1") - F.col("h2"))
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("better"), F.count_if(F.col("d") < 0).alias("worse"), F.count_if(F.col("d") == 0).alias("same"), F.sum("h1").alias("hits_first"), F.sum("h2").alias("hits_second"))


def top_share_precision(df: DataFrame, score: str, tie: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """Hit rate of the first x% of all rows by score."""
    total = df.agg(F.count("*").alias("__n"))
    placed = global_position(df, [F.col(score).desc(), *[F.col(t) for t in tie]], name="place").join(F.broadcast(total))
    cut = placed.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares]))).where(F.col("place") <= F.ceil(F.col("share") * F.col("__n")))
    return precision_by(cut, ["share"])


def edge_split(edges: DataFrame, seed: int = 42, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """Train / valid / test by a hash of the edge; no order and no shuffle needed."""
    u = seeded_hash(seed, *[F.col(c) for c in edges.columns]) / HASH_SPACE
    return edges.withColumn("part", F.when(u < train, "train").when(u < train + valid, "valid").otherwise("test"))


# ---- statistics ------------------------------------------------------------------------
def correlations(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Pearson and Spearman of every pair of columns; ``weak`` marks |r| < 0.3."""
    ranked = df
    for c in columns:
        ranked = average_rank(ranked, c, name=f"rank_{c}")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = ranked.agg(*[F.corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)], *[F.corr(f"rank_{a}", f"rank_{b}").alias(f"s{i}") for i, (a, b) in enumerate(pairs)])
    out = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"p{i}", digits).alias("pearson"), F.round(f"s{i}", digits).alias("spearman")) for i, (a, b) in enumerate(pairs)]))
    return row.select(out.alias("r")).select("r.*").withColumn("weak", F.abs("pearson") < 0.3)


def partial_correlation(df: DataFrame, x: str, y: str, z: str, digits: int = 6) -> DataFrame:
    """Correlation of x and y without z, by the closed formula on one aggregate row."""
    r = df.agg(F.corr(x, y).alias("xy"), F.corr(x, z).alias("xz"), F.corr(y, z).alias("yz"))
    top = F.col("xy") - F.col("xz") * F.col("yz")
    return r.select(F.round("xy", digits).alias("plain"), F.round(top / F.sqrt((1 - F.pow("xz", 2)) * (1 - F.pow("yz", 2))), digits).alias("partial"))


def paired_t(df: DataFrame, a: str, b: str, digits: int = 6) -> DataFrame:
    """Paired t statistic."""
    d = F.col(a) - F.col(b)
    r = df.agg(F.count("*").alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    return r.select("n", F.round("m", digits).alias("mean_difference"), F.when(F.col("s") > 0, F.round(F.col("m") / (F.col("s") / F.sqrt("n")), digits)).alias("t"))


def mann_whitney(df: DataFrame, value: str, group: str, digits: int = 6) -> DataFrame:
    """U of the first group (flag 1) from mid-ranks, and its z."""
    r = average_rank(df.select(value, group), value).agg(
        F.sum(F.col(group)).alias("n1"), F.count("*").alias("n"), F.sum(F.when(F.col(group) == 1, F.col("avg_rank"))).alias("r1")
    )
    n1, n2 = F.col("n1"), F.col("n") - F.col("n1")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    z = (u - n1 * n2 / 2) / F.sqrt(n1 * n2 * (F.col("n") + 1) / 12)
    return r.select("n1", n2.alias("n2"), F.round(u, 4).alias("u"), F.round(z, digits).alias("z"))


def wilcoxon(df: DataFrame, a: str, b: str, digits: int = 6) -> DataFrame:
    """Sum of the positive signed ranks (zero differences dropped) and its z."""
    d = df.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").withColumn("m", F.round(F.abs("d"), 9))
    r = average_rank(d, "m").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("avg_rank"))), F.lit(0.0)).alias("w"))
    n = F.col("n")
    return r.select("n", F.round("w", 4).alias("w_plus"), F.round((F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24), digits).alias("z"))


def erf(x: Column, terms: int = 160) -> Column:
    """Error function of x >= 0 as a Column, by the series 2 / sqrt(pi) exp(-x^2) sum of 2^n x^(2n+1) / (2n+1)!!.

    All terms are positive, so nothing cancels; from 6 on the result is 1 in doubles.
    """
    at = F.when(x.isNotNull(), F.least(x, F.lit(6.0)))
    sums = F.aggregate(
        F.sequence(F.lit(0), F.lit(terms)), F.struct(at.alias("t"), F.lit(0.0).alias("s")),
        lambda acc, n: F.struct((acc["t"] * 2.0 * at * at / (2 * n + 3)).alias("t"), (acc["s"] + acc["t"]).alias("s")),
    )
    return F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-at * at) * sums["s"]


def log_gamma(z: Column) -> Column:
    """ln Gamma(z) for z >= 1 as a Column: Stirling's series at z + 16, less the logarithms of the factors between."""
    w = z + 16.0
    series = (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + 1 / (12 * w) - 1 / (360 * F.pow(w, 3)) + 1 / (1260 * F.pow(w, 5))
    for k in range(16):
        series = series - F.log(z + float(k))
    return series


def binomial_tail(x: Column, n: Column) -> Column:
    """P(X >= x) for n fair draws: terms from the middle outward, each from the one before by their ratio.

    Terms more than 6 sqrt(n) + 100 places out are below 1e-30 of the first and left out.
    """
    upper = x * 2 > n
    start = F.when(upper, x).otherwise(x - 1)  # the lower tail ends at x - 1
    count = F.least(F.when(upper, n - x + 1).otherwise(x), F.floor(6 * F.sqrt(n) + 100))
    first = F.exp(log_gamma(n + 1.0) - log_gamma(start + 1.0) - log_gamma(n - start + 1.0) - n * math.log(2))
    total = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), F.greatest(count - 1, F.lit(0)).cast("bigint")), F.struct(first.alias("t"), F.lit(0.0).alias("s")),
        lambda acc, j: F.struct(
            (acc["t"] * F.when(upper, (n - start - j) / (start + j + 1.0)).otherwise((start - j) / (n - start + j + 1.0))).alias("t"),
            (acc["s"] + acc["t"]).alias("s"),
        ),
    )["s"]
    return F.when(x <= 0, 1.0).when(upper, F.least(total, F.lit(1.0))).otherwise(1.0 - total)


def with_normal_p(df: DataFrame, z: str = "z", digits: int = 9) -> DataFrame:
    """Two-sided normal p-value for each z, null for none."""
    return df.withColumn("p", F.round(1.0 - erf(F.abs(z) / math.sqrt(2)), digits))


def mcnemar(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """T4: both, first only, second only, neither."""
    x = a.select(key, F.col("hit").alias("h1")).join(b.select(key, F.col("hit").alias("h2")), key)
    one, two = F.col("h1") > 0, F.col("h2") > 0
    return x.agg(F.count_if(one & two).alias("both"), F.count_if(one & ~two).alias("first_only"), F.count_if(~one & two).alias("second_only"), F.count_if(~one & ~two).alias("neither"))


def with_sign_p(df: DataFrame, digits: int = 9) -> DataFrame:
    """T4: exact one-sided binomial p of the discordant pairs (``first_only`` or more of all of them)."""
    x = F.col("first_only").cast("double")
    return df.withColumn("p", F.round(binomial_tail(x, x + F.col("second_only")), digits))


def bootstrap_mean(df: DataFrame, key: str, value: str, reps: int = 1000, seed: int = 42, low: float = 0.025, high: float = 0.975, digits: int = 6) -> DataFrame:
    """T5: percentile interval of the mean; draw j of a replicate takes the row at a hashed position.

    The rows are numbered and written once, however much work ``df`` is, and the draws are dealt out by position.
    """
    rows = cut_lineage(df.select(key, value).withColumn("h", seeded_hash(seed, F.col(key))))
    placed = cut_lineage(hash_position(rows, "h", key).select("position", "group_size", value))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = placed.select(F.col("position").alias("j"), F.col("group_size").alias("n")).repartition(tasks, "j").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    pick = (F.pmod(seeded_hash(seed, F.col("rep"), F.col("j")), F.col("n")) + 1).cast("bigint")
    means = (
        draws.select("rep", pick.alias("position")).join(placed.select("position", value), "position")
        .groupBy("rep").agg(F.avg(value).alias("m"))
    )
    return means.agg(F.count("*").alias("reps"), F.round(F.avg("m"), digits).alias("mean"), F.round(F.percentile("m", low), digits).alias("low"), F.round(F.percentile("m", high), digits).alias("high"))


def cohens_d(df: DataFrame, value: str, group: str, digits: int = 6) -> DataFrame:
    """Pooled Cohen's d and its label."""
    g = F.col(group) == 1
    v1, v0 = F.when(g, F.col(value)), F.when(~g, F.col(value))
    r = df.agg(F.count(v1).alias("n1"), F.count(v0).alias("n0"), F.avg(v1).alias("m1"), F.avg(v0).alias("m0"), F.var_samp(v1).alias("s1"), F.var_samp(v0).alias("s0"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("s1") + (F.col("n0") - 1) * F.col("s0")) / (F.col("n1") + F.col("n0") - 2))
    d = F.when(pooled > 0, (F.col("m1") - F.col("m0")) / pooled).otherwise(0.0)
    a = F.abs("d")
    label = F.when(a < 0.2, F.lit("negligible")).when(a < 0.5, F.lit("small")).when(a < 0.8, F.lit("medium")).otherwise(F.lit("large"))
    return r.select("n1", "n0", F.round(d, digits).alias("d")).withColumn("effect", label)


def z_against(df: DataFrame, mean: str, std: str, n: str, baseline: Mapping[str, float] | float, digits: int = 4) -> DataFrame:
    """(mean - baseline) / (std / sqrt(seeds))."""
    base = F.lit(float(baseline)) if isinstance(baseline, (int, float)) else F.element_at(F.create_map(*[F.lit(x) for kv in baseline.items() for x in kv]), F.col("tier"))
    return df.withColumn("z", F.when(F.col(std) > 0, F.round((F.col(mean) - base) / (F.col(std) / F.sqrt(n)), digits)))
