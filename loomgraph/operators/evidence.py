"""L: evidence levels, validation scores and co-occurrence in a corpus."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of trial phases and statuses in a validation score.
PHASE_WEIGHTS = {"Phase 4": 1.0, "Phase 3": 0.8, "Phase 2": 0.5, "Phase 1": 0.3}
OTHER_PHASE = 0.2
STATUS_WEIGHTS = {"COMPLETED": 1.0, "ACTIVE_NOT_RECRUITING": 0.8, "RECRUITING": 0.7, "NOT_YET_RECRUITING": 0.5}
OTHER_STATUS = 0.3


def _any_phase(phases: Column, *numbers: int) -> Column:
    pattern = "|".join(f"PHASE{n}|Phase {n}" for n in numbers)
    return F.exists(phases, lambda p: p.rlike(pattern))


def evidence_points() -> Column:
    """L1: points from trials, publications, treatment context and confirmation."""
    phases, total, clinical = F.col("phases"), F.col("pubmed_total"), F.col("pubmed_clinical")
    trial = F.when(F.col("trial_count") > 0, F.when(_any_phase(phases, 3, 4), 4.0).when(_any_phase(phases, 2), 2.5).otherwise(1.0)).otherwise(0.0)
    papers = (
        F.when((total >= 20) & (clinical > 0), 3.0)
        .when(total >= 5, F.lit(1.5) + F.when(F.col("pubmed_recent") >= 3, 0.5).otherwise(0.0))
        .when(total >= 1, 0.5).otherwise(0.0)
    )
    context = F.when(F.col("treatment_context") >= 5, 1.0).when(F.col("treatment_context") >= 1, 0.3).otherwise(0.0)
    more = F.when(clinical >= 3, 1.0).otherwise(0.0)
    confirmed = F.when(F.col("confirmed") & ~F.col("adverse"), 2.0).otherwise(0.0)
    return F.round(trial + papers + context + more + confirmed, 2)


def evidence_level(points: Column, adverse: Column) -> Column:
    return (
        F.when(adverse, F.lit("ADVERSE_EFFECT")).when(points >= 4, F.lit("STRONG_EVIDENCE")).when(points >= 2, F.lit("MODERATE_EVIDENCE"))
        .when(points > 0, F.lit("WEAK_EVIDENCE")).otherwise(F.lit("NO_EVIDENCE"))
    )


def _best_weight(values: Column, weights: Mapping[str, float], other: float) -> Column:
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.array_max(F.transform(values, lambda v: F.coalesce(F.element_at(table, v), F.lit(other)))), F.lit(0.0))


def validation_score(digits: int = 6) -> dict[str, Column]:
    """L2: trial and literature scores, their 0.6 / 0.4 mean, and the mean reduced by confounding."""
    lit = lambda c, n, cap: F.least(F.col(c) / n, F.lit(cap))
    trial = F.when(
        F.col("trial_count") > 0,
        _best_weight(F.col("phases"), PHASE_WEIGHTS, OTHER_PHASE) * 0.5 + _best_weight(F.col("statuses"), STATUS_WEIGHTS, OTHER_STATUS) * 0.3 + lit("trial_count", 10, 1.0) * 0.2,
    ).otherwise(0.0)
    papers = F.when(
        F.col("pubmed_total") > 0,
        lit("pubmed_total", 50, 1.0) * 0.4 + lit("pubmed_recent", 20, 0.5) + lit("pubmed_review", 5, 0.3) + lit("pubmed_clinical", 5, 0.3),
    ).otherwise(0.0)
    both = trial * 0.6 + papers * 0.4
    cut = both * (1 - F.coalesce(F.col("confounding"), F.lit(0.0)))
    return {"trial_score": F.round(trial, digits), "literature_score": F.round(papers, digits), "validation_score": F.round(both, digits), "adjusted_score": F.round(cut, digits)}


def score_band(score: Column) -> Column:
    """L3."""
    return F.when(score >= 0.5, F.lit("strong")).when(score >= 0.2, F.lit("moderate")).when(score > 0, F.lit("weak")).otherwise(F.lit("none"))


def upsert_new(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows stay as they are, rows with new keys are added."""
    return stored.unionByName(incoming.join(stored.select(*keys), list(keys), "left_anti"))


def newest(rows: DataFrame, keys: Sequence[str], version: str = "version") -> DataFrame:
    """Merge on read: of every key the row of the highest version (of equal ones the largest row), without the version."""
    rest = [c for c in rows.columns if c not in (*keys, version)]
    best = rows.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}") for c in rest))


def upsert_refreshed(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], refresh: Column) -> DataFrame:
    """L5 with forced refresh: a stored row stays unless an incoming row of its key meets ``refresh``; new keys are added.

    One aggregate over both tables with rows as versions (known and not forced < stored < forced), so no join is needed and
    repeated keys are combined before the shuffle. A null ``refresh`` counts as false.
    """
    version = F.when(F.coalesce(refresh, F.lit(False)), 1).otherwise(-1)
    columns = stored.columns
    return newest(
        stored.withColumn("version", F.lit(0)).unionByName(incoming.withColumn("version", version).select(*columns, "version")), keys
    ).select(*columns)


def cooccurrence(documents: DataFrame, left: DataFrame, right: DataFrame, treatment_words: Sequence[str]) -> DataFrame:
    """Documents per (left, right) term pair: both terms; plus a treatment word; recent; review.

    ``documents`` (doc_id, text, recent, review), ``left`` (l_term), ``right`` (r_term).  A term is
    looked up by its first word in the distinct words of a whole text and confirmed as a phrase.
    """
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), F.lit(" "))
    docs = documents.select("doc_id", "recent", "review", plain.alias("plain"))
    treated = F.lit(False)
    for w in treatment_words:
        treated = treated | F.contains("plain", F.lit(f" {w} "))
    tokens = docs.select("doc_id", "plain", F.explode(F.array_distinct(F.split(F.trim("plain"), " "))).alias("token"))

    def found(terms: DataFrame, name: str) -> DataFrame:
        t = terms.select(F.lower(name).alias(name)).distinct().withColumn("token", F.split_part(name, F.lit(" "), F.lit(1)))
        return tokens.join(t, "token").where(F.contains("plain", F.concat(F.lit(" "), F.col(name), F.lit(" ")))).select("doc_id", name)

    both = found(left, "l_term").join(found(right, "r_term"), "doc_id").where(F.col("l_term") != F.col("r_term"))
    flags = docs.select("doc_id", treated.alias("treated"), "recent", "review")
    return both.join(flags, "doc_id").groupBy("l_term", "r_term").agg(
        F.count("*").alias("both_terms"), F.count_if("treated").alias("treatment"), F.count_if("recent").alias("recent"), F.count_if("review").alias("review")
    )


def adverse_crosscheck(predictions: DataFrame, effects: DataFrame, matches: DataFrame, known: DataFrame) -> DataFrame:
    """Predicted pairs whose context matches a side effect of the item, minus known pairs.

    ``predictions`` (context, item, item_name, context_name), ``effects`` (name, term),
    ``matches`` (context_name, term).
    """
    hit = predictions.join(effects.withColumnRenamed("name", "item_name"), "item_name").join(matches, ["context_name", "term"])
    return hit.join(known, ["context", "item"], "left_anti").select("context", "item", "term").distinct()
