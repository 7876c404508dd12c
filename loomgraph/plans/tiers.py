"""The ordered tier chain (P6) with its category rescue (P7), built from word lists that are parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import rules as P
from loomgraph.operators.rules import Rule


@dataclass(frozen=True)
class TierWords:
    """Everything the chain needs to know about a domain; all of it is data."""

    inverse: Sequence[tuple[str, Sequence[str]]] = ()
    non_therapeutic: Sequence[str] = ()
    procedural: Sequence[str] = ()
    procedural_strict: Sequence[str] = ()
    procedural_categories: Sequence[str] = ()
    activity_category: str = ""
    activity: Mapping[str, Sequence[str]] = field(default_factory=dict)
    needed: Mapping[str, str] = field(default_factory=dict)
    activity_exempt: Sequence[tuple[str, str]] = ()
    typed_category: str = ""
    types: Mapping[str, Sequence[str]] = field(default_factory=dict)
    targeted: Sequence[str] = ()
    steroids: Sequence[str] = ()
    steroid_blocked_category: str = ""
    steroid_harm: Sequence[str] = ()
    validated: Sequence[str] = ()
    complications: Mapping[str, Sequence[str]] = field(default_factory=dict)
    transfer: Mapping[str, float] = field(default_factory=dict)
    transfer_special: Sequence[str] = ()
    mechanism_specific: Sequence[str] = ()
    category_only: Sequence[str] = ()
    category_only_contexts: Sequence[str] = ()
    complication_contexts: Sequence[str] = ()
    complication_classes: Sequence[str] = ()
    pathway_contexts: Sequence[str] = ()
    pathway_items: Sequence[str] = ()
    groups: Mapping[str, Mapping[str, Sequence[str]]] = field(default_factory=dict)
    group_exclusions: Mapping[tuple[str, str], Sequence[str]] = field(default_factory=dict)
    group_low: Sequence[str] = ()
    group_medium: Sequence[str] = ()
    group_high: Sequence[str] = ()
    group_golden: Sequence[str] = ()
    golden_categories: Sequence[str] = ()
    rescue: Sequence[Rule] = ()
    zero_pairs: Sequence[tuple[str, str]] = ()
    coherent: Mapping[str, Sequence[str]] = field(default_factory=dict)
    coherent_excluded: Sequence[str] = ()
    demoted_categories: Sequence[str] = ()
    established_category: str = ""
    established: Sequence[str] = ()
    repurposable: Sequence[str] = ()
    low_score: float = 3.0
    mid_score: float = 5.0


def tier_rules(w: TierWords) -> list[Rule]:
    """The chain in order, over the columns of ``enriched``."""
    item, ctx, cat = F.lower("item_name"), F.lower("context_name"), F.col("category")
    rank, freq, mech, score = F.col("rank"), F.col("train_frequency"), F.col("mechanism"), F.col("score")
    none = lambda ws: T.contains_any(item, ws)
    inverse = F.lit(False)
    for word, contexts in w.inverse:
        inverse = inverse | (F.contains(item, F.lit(word)) & T.contains_any(ctx, contexts))
    same = (cat == w.typed_category) & F.col("same_type")
    steroid = none(w.steroids)
    validated = none(w.validated)
    transfer = F.col("transfer")
    special = none(w.transfer_special) & (transfer >= 50)
    named = lambda prefix: F.concat(F.lit(prefix), F.format_string("%.0f", transfer))
    grouped = F.col("grp").isNotNull()
    group_rule = F.concat(cat, F.lit("_hierarchy_"), F.col("grp"))
    in_group = lambda gs: grouped & F.col("grp").isin(*gs) if gs else F.lit(False)
    coherent = F.col("coherent")
    rescue = P.first_match(w.rescue) if w.rescue else F.struct(F.lit(None).cast("string").alias("tier"), F.lit(None).cast("string").alias("rule"))
    top1 = (F.col("category_tier") == 1) & (freq >= 10) & mech
    strong = (freq >= 15) & mech
    early = (rank <= 5) & (freq >= 10) & mech
    demoted = cat.isin(*w.demoted_categories) if w.demoted_categories else F.lit(False)
    excluded = cat.isin(*w.coherent_excluded) if w.coherent_excluded else F.lit(False)
    return [
        Rule("inverse_indication", inverse, "FILTER"),
        Rule("non_therapeutic_compound", none(w.non_therapeutic), "FILTER"),
        Rule("local_anesthetic_procedural", none(w.procedural_strict), "LOW"),
        Rule("local_anesthetic_procedural", none(w.procedural) & ~cat.isin(*w.procedural_categories), "LOW"),
        Rule("antimicrobial_pathogen_mismatch", (cat == w.activity_category) & P.activity_mismatch(item, ctx, w.activity, w.needed, w.activity_exempt), "LOW"),
        Rule("cancer_targeted_therapy", same & none(w.targeted), "LOW"),
        Rule("cancer_same_type_mech_rank10", same & mech & (rank <= 10), "HIGH"),
        Rule("cancer_same_type_no_mechanism", same & ~mech, "LOW"),
        Rule("cancer_same_type_high_rank", same & (rank >= 21), "MEDIUM"),
        Rule("cancer_same_type", same, "MEDIUM"),
        Rule("cancer_no_gt", (cat == w.typed_category) & ~F.col("has_type"), "FILTER"),
        Rule(None, rank > 20, "FILTER"),
        Rule(None, ~F.col("has_targets"), "FILTER"),
        Rule(None, (freq <= 2) & ~mech & ~validated, "FILTER"),
        Rule(None, steroid & (cat == w.steroid_blocked_category), "FILTER"),
        Rule("corticosteroid_iatrogenic", steroid & T.contains_any(ctx, w.steroid_harm), "FILTER"),
        Rule("cross_domain_isolated", F.col("only_category").isNotNull() & (F.col("only_category") != cat), "FILTER"),
        Rule("base_to_complication", F.col("base_to_comp"), "FILTER"),
        Rule("statin_cv_event", special, "GOLDEN"),
        Rule(named("comp_to_base_high_"), transfer >= 50, "HIGH"),
        Rule(named("comp_to_base_med_"), transfer >= 20, "MEDIUM"),
        Rule("mechanism_specific", ctx.isin(*w.mechanism_specific), "LOW"),
        Rule("cancer_only_non_cancer", none(w.category_only) & ~T.contains_any(ctx, w.category_only_contexts), "FILTER"),
        Rule("complication_non_validated", T.contains_any(ctx, w.complication_contexts) & none(w.complication_classes) & ~validated, "FILTER"),
        Rule("cv_pathway_comprehensive", T.contains_any(ctx, w.pathway_contexts) & none(w.pathway_items), "MEDIUM"),
        Rule(group_rule, in_group(w.group_low), "LOW"),
        Rule(group_rule, in_group(w.group_medium), "MEDIUM"),
        Rule(group_rule, in_group(w.group_high), "HIGH"),
        Rule(group_rule, in_group(w.group_golden), "GOLDEN"),
        Rule(group_rule, grouped & cat.isin(*w.golden_categories), "GOLDEN"),
        Rule(group_rule, grouped, "HIGH"),
        Rule(cat, (F.col("category_tier") > 1) & rescue.getField("tier").isNotNull(), rescue.getField("tier")),
        Rule("zero_precision_mismatch", P.mismatch(F.col("code"), cat, w.zero_pairs) & ~validated, "FILTER"),
        Rule("incoherent_demotion", top1 & ~coherent, "HIGH"),
        Rule(None, top1, "GOLDEN"),
        Rule("incoherent_demotion", strong & ~coherent, "LOW"),
        Rule(None, strong, "HIGH"),
        Rule("incoherent_demotion", early & ~coherent, "LOW"),
        Rule(None, early, "HIGH"),
        Rule("cv_established_drug_rescue", demoted & (cat == w.established_category) & none(w.established) & mech, "MEDIUM"),
        Rule(F.concat(cat, F.lit("_medium_demotion")), demoted, "LOW"),
        Rule("default_freq5_mechanism", (freq >= 5) & mech, "MEDIUM"),
        Rule("default_no_mech_high_rank", (freq >= 10) & (rank >= 11) & ~mech, "LOW"),
        Rule("default_freq10_mechanism", (freq >= 10) & mech, "MEDIUM"),
        Rule("default_nomech_low_score", (freq >= 10) & (score < w.low_score), "LOW"),
        Rule("default_nomech_r1_5_low_score", (freq >= 10) & (rank <= 5) & (score < w.mid_score), "LOW"),
        Rule("default_freq10_nomech_r1_5", (freq >= 10) & (rank <= 5), "HIGH"),
        Rule("default_freq10_nomech_r6_10", freq >= 10, "MEDIUM"),
        Rule("highly_repurposable", none(w.repurposable) & (mech | (freq >= 5)), "LOW"),
        Rule(F.concat(F.lit("atc_coherent_"), cat), ~excluded & coherent & (rank <= 10) & (mech | (freq >= 3)), "MEDIUM"),
    ]


def enriched(
    top: DataFrame, truth: DataFrame, contexts: DataFrame, items: DataFrame, item_features: DataFrame,
    context_features: DataFrame, w: TierWords, category_tiers: Mapping[str, int], truth_for_domains: DataFrame | None = None,
) -> DataFrame:
    """One row per prediction with every column that the rules read.

    All lookups start from the ranked candidates (at most ``n`` per context), so the work grows
    with the answer and not with the product of contexts and items.
    """
    from loomgraph.operators.graph import pair_overlap

    c = contexts.select("context", F.col("name").alias("context_name"), "category")
    i = items.select("item", F.col("name").alias("item_name"), F.col("class1").alias("code"))
    freq = truth.groupBy("item").agg(F.count("*").alias("train_frequency"))
    out = top.join(c, "context").join(i, "item").join(freq, "item", "left")
    out = pair_overlap(out, item_features, context_features)
    named_truth = truth.join(contexts.select("context", F.col("name").alias("context_name")), "context")
    typed = contexts.select("context", F.explode(P.word_types(F.col("name"), w.types, short=8)).alias("type"))
    out = P.type_match(out, truth, typed)
    out = P.group_match(out, truth, contexts, w.groups, w.group_exclusions)
    out = out.join(P.isolated_items(truth if truth_for_domains is None else truth_for_domains, contexts.select("context", "category")), "item", "left")
    out = P.base_and_complication(out, named_truth, w.complications, w.transfer)
    tier = F.lit(3)
    for cat, n in category_tiers.items():
        tier = F.when(F.col("category") == cat, n).otherwise(tier)
    return out.withColumns({
        "train_frequency": F.coalesce("train_frequency", F.lit(0)),
        "mechanism": F.col("overlap") > 0,
        "has_targets": F.col("n_item_features") > 0,
        "category_tier": tier,
        "coherent": P.class_coherent(F.array("code"), F.col("category"), w.coherent),
    })


def tiered(df: DataFrame, w: TierWords) -> DataFrame:
    """P6 + P7: tier and rule of every row."""
    return df.withColumn("o", P.first_match(tier_rules(w), "LOW")).withColumns({"tier": F.col("o.tier"), "rule": F.col("o.rule")}).drop("o")
