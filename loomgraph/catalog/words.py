"""Neutral word lists for the rule entries, on the names of the driver tables."""

from pyspark.sql import functions as F

from loomgraph.operators.rules import Rule
from loomgraph.plans.tiers import TierWords

CATEGORY_TIERS = {"furniture": 1, "household": 1, "machinery": 2, "building": 2}
TYPES = {"north": ["nation_1", "nation_2", "nation_3"], "south": ["nation_10", "nation_11", "nation_12"], "east": ["nation_20", "nation_21", "nation_3"]}


def _has(word):
    return F.contains(F.col("item_name"), F.lit(word))


def rescue_rules():
    cat, rank, mech = F.col("category"), F.col("rank"), F.col("mechanism")
    return [
        Rule(None, (cat == "machinery") & _has("bolt") & (rank <= 10), "HIGH"),
        Rule(None, (cat == "machinery") & _has("gizmo"), "LOW"),
        Rule(None, (cat == "building") & _has("old") & (rank <= 5) & mech, "GOLDEN"),
        Rule(None, (cat == "building") & (rank <= 5) & mech, "MEDIUM"),
    ]


RESCUE_SQL = """CASE WHEN category = 'machinery' AND contains(item_name, 'bolt') AND rank <= 10 THEN 'HIGH'
  WHEN category = 'machinery' AND contains(item_name, 'gizmo') THEN 'LOW'
  WHEN category = 'building' AND contains(item_name, 'old') AND rank <= 5 AND mechanism THEN 'GOLDEN'
  WHEN category = 'building' AND rank <= 5 AND mechanism THEN 'MEDIUM' END"""


def words() -> TierWords:
    return TierWords(
        inverse=[("red ring", ["nation_7", "nation_8"])], non_therapeutic=["old anvil"], procedural=["rod"],
        procedural_strict=["cold rod"], procedural_categories=["building", "furniture", "household"], activity_category="household",
        activity={"heat": ["hot"], "chill": ["cold"]}, needed={"nation_2": "heat", "nation_3": "chill"},
        activity_exempt=[("hot bolt", "household nation_3")], typed_category="automobile", types=TYPES, targeted=["gizmo"],
        steroids=["plate"], steroid_blocked_category="machinery", steroid_harm=["nation_5"], validated=["new gear"],
        complications={"furniture nation_1": ["furniture nation_4", "building nation_4"]},
        transfer={"furniture nation_4": 60.0, "building nation_4": 25.0}, transfer_special=["gear"],
        mechanism_specific=["building nation_9"], category_only=["blue widget"], category_only_contexts=["machinery"],
        complication_contexts=["nation_14"], complication_classes=["small"], pathway_contexts=["nation_15"], pathway_items=["large"],
        groups={"furniture": {"low": ["nation_1", "nation_2"], "mid": ["nation_6"]}, "household": {"low": ["nation_4"], "far": ["nation_22", "nation_23"], "old": ["nation_9"]}},
        group_exclusions={("furniture", "low"): ["nation_19"]}, group_low=["old"], group_medium=["far"], group_golden=["mid"],
        golden_categories=["household"], rescue=rescue_rules(), zero_pairs=[("PROMO", "building"), ("SMALL", "machinery")],
        coherent={"furniture": ["STANDARD", "LARGE", "SMALL"], "household": ["ECONOMY", "PROMO"], "machinery": ["LARGE", "MEDIUM"], "building": ["STANDARD", "MEDIUM"], "automobile": ["PROMO", "SMALL"]},
        coherent_excluded=["machinery"], demoted_categories=["building"], established_category="building", established=["hot"],
        repurposable=["red"], low_score=0.3, mid_score=0.6,
    )


# one CASE per rule of the chain: 'TIER|rule'
_T = [
    ("contains(item_name, 'red ring') AND regexp_matches(context_name, '(nation_7|nation_8)')", "'FILTER|inverse_indication'"),
    ("contains(item_name, 'old anvil')", "'FILTER|non_therapeutic_compound'"),
    ("contains(item_name, 'cold rod')", "'LOW|local_anesthetic_procedural'"),
    ("contains(item_name, 'rod') AND category NOT IN ('building', 'furniture', 'household')", "'LOW|local_anesthetic_procedural'"),
    ("category = 'household' AND need IS NOT NULL AND (contains(item_name, 'hot') OR contains(item_name, 'cold')) AND NOT ((need = 'heat' AND contains(item_name, 'hot')) OR (need = 'chill' AND contains(item_name, 'cold'))) AND NOT (item_name = 'hot bolt' AND context_name = 'household nation_3')", "'LOW|antimicrobial_pathogen_mismatch'"),
    ("category = 'automobile' AND same_type AND contains(item_name, 'gizmo')", "'LOW|cancer_targeted_therapy'"),
    ("category = 'automobile' AND same_type AND mechanism AND rank <= 10", "'HIGH|cancer_same_type_mech_rank10'"),
    ("category = 'automobile' AND same_type AND NOT mechanism", "'LOW|cancer_same_type_no_mechanism'"),
    ("category = 'automobile' AND same_type AND rank >= 21", "'MEDIUM|cancer_same_type_high_rank'"),
    ("category = 'automobile' AND same_type", "'MEDIUM|cancer_same_type'"),
    ("category = 'automobile' AND NOT has_type", "'FILTER|cancer_no_gt'"),
    ("rank > 20", "'FILTER|'"), ("NOT has_targets", "'FILTER|'"),
    ("train_frequency <= 2 AND NOT mechanism AND NOT contains(item_name, 'new gear')", "'FILTER|'"),
    ("contains(item_name, 'plate') AND category = 'machinery'", "'FILTER|'"),
    ("contains(item_name, 'plate') AND contains(context_name, 'nation_5')", "'FILTER|corticosteroid_iatrogenic'"),
    ("only_category IS NOT NULL AND only_category <> category", "'FILTER|cross_domain_isolated'"),
    ("base_to_comp", "'FILTER|base_to_complication'"),
    ("transfer >= 50 AND contains(item_name, 'gear')", "'GOLDEN|statin_cv_event'"),
    ("transfer >= 50", "'HIGH|comp_to_base_high_' || transfer::INT"), ("transfer >= 20", "'MEDIUM|comp_to_base_med_' || transfer::INT"),
    ("context_name = 'building nation_9'", "'LOW|mechanism_specific'"),
    ("contains(item_name, 'blue widget') AND NOT contains(context_name, 'machinery')", "'FILTER|cancer_only_non_cancer'"),
    ("contains(context_name, 'nation_14') AND contains(item_name, 'small') AND NOT contains(item_name, 'new gear')", "'FILTER|complication_non_validated'"),
    ("contains(context_name, 'nation_15') AND contains(item_name, 'large')", "'MEDIUM|cv_pathway_comprehensive'"),
    ("grp = 'old'", "'LOW|' || category || '_hierarchy_' || grp"), ("grp = 'far'", "'MEDIUM|' || category || '_hierarchy_' || grp"),
    ("grp = 'mid'", "'GOLDEN|' || category || '_hierarchy_' || grp"), ("grp IS NOT NULL AND category = 'household'", "'GOLDEN|' || category || '_hierarchy_' || grp"),
    ("grp IS NOT NULL", "'HIGH|' || category || '_hierarchy_' || grp"),
    (f"category_tier > 1 AND ({RESCUE_SQL}) IS NOT NULL", f"({RESCUE_SQL}) || '|' || category"),
    ("((code = 'PROMO' AND category = 'building') OR (code = 'SMALL' AND category = 'machinery')) AND NOT contains(item_name, 'new gear')", "'FILTER|zero_precision_mismatch'"),
    ("category_tier = 1 AND train_frequency >= 10 AND mechanism AND NOT coherent", "'HIGH|incoherent_demotion'"),
    ("category_tier = 1 AND train_frequency >= 10 AND mechanism", "'GOLDEN|'"),
    ("train_frequency >= 15 AND mechanism AND NOT coherent", "'LOW|incoherent_demotion'"), ("train_frequency >= 15 AND mechanism", "'HIGH|'"),
    ("rank <= 5 AND train_frequency >= 10 AND mechanism AND NOT coherent", "'LOW|incoherent_demotion'"), ("rank <= 5 AND train_frequency >= 10 AND mechanism", "'HIGH|'"),
    ("category = 'building' AND contains(item_name, 'hot') AND mechanism", "'MEDIUM|cv_established_drug_rescue'"), ("category = 'building'", "'LOW|building_medium_demotion'"),
    ("train_frequency >= 5 AND mechanism", "'MEDIUM|default_freq5_mechanism'"), ("train_frequency >= 10 AND rank >= 11 AND NOT mechanism", "'LOW|default_no_mech_high_rank'"),
    ("train_frequency >= 10 AND mechanism", "'MEDIUM|default_freq10_mechanism'"), ("train_frequency >= 10 AND score < 0.3", "'LOW|default_nomech_low_score'"),
    ("train_frequency >= 10 AND rank <= 5 AND score < 0.6", "'LOW|default_nomech_r1_5_low_score'"), ("train_frequency >= 10 AND rank <= 5", "'HIGH|default_freq10_nomech_r1_5'"),
    ("train_frequency >= 10", "'MEDIUM|default_freq10_nomech_r6_10'"), ("contains(item_name, 'red') AND (mechanism OR train_frequency >= 5)", "'LOW|highly_repurposable'"),
    ("category <> 'machinery' AND coherent AND rank <= 10 AND (mechanism OR train_frequency >= 3)", "'MEDIUM|atc_coherent_' || category"),
]
TIER_CASE = "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in _T) + " ELSE 'LOW|' END"
TIER_HITS = " + ".join(f"(CASE WHEN {c} THEN 1 ELSE 0 END)" for c, _ in _T)
