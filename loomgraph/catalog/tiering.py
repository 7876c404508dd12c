"""P and R entries: rule engine, tier chain and prediction reports."""

from pyspark.sql import functions as F

from loomgraph.catalog.base import VIEWS, entry, restated, view
from loomgraph.catalog.similarity import top_items, translation
from loomgraph.catalog.words import CATEGORY_TIERS, RESCUE_SQL, TIER_CASE, TIER_HITS, TYPES, rescue_rules, words
from loomgraph.operators import aggregate as A
from loomgraph.operators import ranking as W
from loomgraph.operators import rules as P
from loomgraph.operators import similar as S
from loomgraph.plans import tiers as TI
from loomgraph.plans import predict as PR

KEYWORDS = {"wood": ["furniture", "nation_24"], "engine": ["machinery", "automobile"], "site": ["building", "nation_1"]}
KEY_SQL = "CASE WHEN regexp_matches(name, '(furniture|nation_24)') THEN 'wood' WHEN regexp_matches(name, '(machinery|automobile)') THEN 'engine' WHEN regexp_matches(name, '(building|nation_1)') THEN 'site' ELSE 'other' END"


@entry("p1_keyword_category", f"SELECT context, {KEY_SQL} AS kind FROM contexts_v")
def _(t):
    return t.contexts().select("context", P.keyword_category(F.col("name"), KEYWORDS).alias("kind"))


LABELS = {"metal": ["bolt", "gear", "rod", "anvil"], "colour": ["red", "blue"], "thermal": ["hot", "cold"], "flat": ["ring", "plate", "rod"]}


@entry("p2_keyword_categories", """
  SELECT item, CASE WHEN len(k) > 0 THEN array_to_string(list_sort(k), ',') ELSE 'other' END AS kinds, len(k) > 1 AS crosses FROM (
    SELECT item, list_filter([CASE WHEN regexp_matches(name, '(bolt|gear|rod|anvil)') THEN 'metal' END, CASE WHEN regexp_matches(name, '(red|blue)') THEN 'colour' END,
      CASE WHEN regexp_matches(name, '(hot|cold)') THEN 'thermal' END, CASE WHEN regexp_matches(name, '(ring|plate|rod)') THEN 'flat' END], lambda x: x IS NOT NULL) AS k FROM items_v)""")
def _(t):
    k = P.keyword_categories(F.col("name"), LABELS)
    return t.items().select("item", k.alias("k")).select("item", F.concat_ws(",", "k").alias("kinds"), (F.size("k") > 1).alias("crosses"))


PATTERNS = [("fastener", "bolt$"), ("moving", "(gear|widget)$"), ("thermal", "^(hot|cold) "), ("coloured", "^(red|blue)")]


@entry("p3_pattern_type", """
  SELECT item, CASE WHEN regexp_matches(lower(name), 'bolt$') THEN 'fastener' WHEN regexp_matches(lower(name), '(gear|widget)$') THEN 'moving'
    WHEN regexp_matches(lower(name), '^(hot|cold) ') THEN 'thermal' WHEN regexp_matches(lower(name), '^(red|blue)') THEN 'coloured' ELSE 'small_part' END AS kind FROM items_v""")
def _(t):
    return t.items().select("item", P.pattern_type(F.col("name"), PATTERNS, "small_part").alias("kind"))


def word_sql(kind):
    return "regexp_matches(name, '\\b(" + "|".join(TYPES[kind]) + ")\\b')"


view("types_v", " UNION ALL ".join(f"SELECT context, '{k}' AS type FROM contexts_v WHERE {word_sql(k)}" for k in TYPES))
view("item_types_v", "SELECT DISTINCT item, type FROM truth_v JOIN types_v USING (context)")


@entry("p4_type_match", """
  SELECT v.context, v.item, v.item IN (SELECT item FROM item_types_v) AS has_type,
    EXISTS (SELECT 1 FROM types_v y JOIN item_types_v i ON i.type = y.type WHERE y.context = v.context AND i.item = v.item) AS same_type FROM top_v v""")
def _(t):
    typed = t.contexts().select("context", F.explode(P.word_types(F.col("name"), TYPES, short=8)).alias("type"))
    return P.type_match(top_items(t).select("context", "item"), t.truth(), typed)


view("hierarchy_v", """
  SELECT context, category, g.cat, g.grp, g.o FROM contexts_v JOIN (VALUES (0, 'furniture', 'low', '(nation_1|nation_2)', 'nation_19'), (1, 'furniture', 'mid', '(nation_6)', '#'),
    (2, 'household', 'low', '(nation_4)', '#'), (3, 'household', 'far', '(nation_22|nation_23)', '#'), (4, 'household', 'old', '(nation_9)', '#')) AS g(o, cat, grp, p, veto)
  ON regexp_matches(name, g.p) AND NOT contains(name, g.veto)""")
view("item_groups_known_v", "SELECT DISTINCT item, cat, grp FROM truth_v JOIN hierarchy_v USING (context)")
view("context_group_v", "SELECT context, category, arg_min(grp, o) AS grp FROM hierarchy_v WHERE cat = category GROUP BY 1, 2")
view("group_match_v", """
  SELECT v.context, v.item, k.grp FROM top_v v LEFT JOIN context_group_v g ON g.context = v.context
  LEFT JOIN item_groups_known_v k ON k.item = v.item AND k.cat = g.category AND k.grp = g.grp""")


@entry("p5_hierarchy_group_match", "SELECT * FROM group_match_v")
def _(t):
    w = words()
    return P.group_match(top_items(t).select("context", "item"), t.truth(), t.contexts(), w.groups, w.group_exclusions)


view("isolated_v", "SELECT item, min(category) AS only_category FROM truth_v JOIN contexts_v USING (context) GROUP BY 1 HAVING count(DISTINCT category) = 1")
view("treats_v", """
  SELECT item, bool_or(contains(name, 'furniture nation_1')) AS b1, bool_or(contains(name, 'furniture nation_4')) AS c1, bool_or(contains(name, 'building nation_4')) AS c2
  FROM truth_v JOIN contexts_v USING (context) GROUP BY 1""")
view("frequency_v", "SELECT item, count(*) AS train_frequency FROM truth_v GROUP BY 1")
view("coherent_v", """SELECT * FROM (VALUES ('furniture', 'STANDARD'), ('furniture', 'LARGE'), ('furniture', 'SMALL'), ('household', 'ECONOMY'), ('household', 'PROMO'), ('machinery', 'LARGE'),
  ('machinery', 'MEDIUM'), ('building', 'STANDARD'), ('building', 'MEDIUM'), ('automobile', 'PROMO'), ('automobile', 'SMALL')) AS c(category, code)""")
view("enriched_v", """
  SELECT v.context, v.item, v.score, v.rank, v.norm_score, c.name AS context_name, c.category, i.name AS item_name, i.class1 AS code,
    coalesce(f.train_frequency, 0) AS train_frequency, s.n_shared AS overlap, s.n_shared > 0 AS mechanism,
    v.item IN (SELECT item FROM item_features_v) AS has_targets, g.grp, o.only_category,
    v.item IN (SELECT item FROM item_types_v) AS has_type, st.item IS NOT NULL AS same_type,
    CASE c.category WHEN 'furniture' THEN 1 WHEN 'household' THEN 1 WHEN 'machinery' THEN 2 WHEN 'building' THEN 2 ELSE 3 END AS category_tier,
    (c.category, i.class1) IN (SELECT (category, code) FROM coherent_v) AS coherent,
    CASE WHEN contains(c.name, 'nation_2') THEN 'heat' WHEN contains(c.name, 'nation_3') THEN 'chill' END AS need,
    coalesce(tr.b1, false) AND (c.name IN ('furniture nation_4', 'building nation_4') OR starts_with(c.name, 'furniture nation_4 ') OR starts_with(c.name, 'building nation_4 ')) AS base_to_comp,
    CASE WHEN coalesce(tr.c1, false) AND contains(c.name, 'furniture nation_1') THEN 60.0 WHEN coalesce(tr.c2, false) AND contains(c.name, 'furniture nation_1') THEN 25.0 END AS transfer
  FROM top_v v JOIN contexts_v c USING (context) JOIN items_v i USING (item) LEFT JOIN frequency_v f USING (item) JOIN shared_v s ON s.context = v.context AND s.item = v.item
  JOIN group_match_v g ON g.context = v.context AND g.item = v.item LEFT JOIN isolated_v o ON o.item = v.item LEFT JOIN treats_v tr ON tr.item = v.item
  LEFT JOIN (SELECT DISTINCT y.context, k.item FROM types_v y JOIN item_types_v k ON k.type = y.type) st ON st.context = v.context AND st.item = v.item""")
view("tiered_v", f"SELECT * EXCLUDE (o), split_part(o, '|', 1) AS tier, nullif(split_part(o, '|', 2), '') AS rule FROM (SELECT *, {TIER_CASE} AS o FROM enriched_v)")


def enriched(t, top=None, truth=None):
    return TI.enriched(top_items(t) if top is None else top, t.truth() if truth is None else truth, t.contexts(), t.items(), t.item_features(), t.context_features(), words(), CATEGORY_TIERS)


def tiered(t):
    return TI.tiered(enriched(t), words())


COLS = ["context", "item", "rank", "train_frequency", "overlap", "mechanism", "category", "category_tier", "coherent", "grp", "transfer", "tier", "rule"]


@entry("p6_tier_chain", f"SELECT {', '.join(COLS)} FROM tiered_v")
def _(t):
    return tiered(t).select(*COLS)


@entry("p7_category_rescue", f"SELECT context, item, {RESCUE_SQL} AS rescue FROM enriched_v")
def _(t):
    return enriched(t).select("context", "item", P.first_match(rescue_rules()).getField("tier").alias("rescue"))


SAFETY = [("hot rod", "furniture", "Withdrawn for this use"), ("hot", "nation_7", "Wrong temperature"), ("gizmo", "household", "No mechanism"), ("large", "nation_2", "Too large")]
SAFE_SQL = "CASE " + " ".join(f"WHEN contains(lower(item_name), '{a}') AND contains(lower(context_name), '{b}') THEN 'EXCLUDED|{r}'" for a, b, r in SAFETY) + """
  WHEN contains(item_name, 'bolt') THEN 'HIGH|Best class' WHEN contains(item_name, 'ring') AND score >= 0.5 THEN 'HIGH|Ring with a high score' WHEN contains(item_name, 'ring') THEN 'MEDIUM|Ring' WHEN contains(item_name, 'cold') THEN 'LOW|Needs validation' ELSE 'MEDIUM|Default classification' END"""
view("safety_v", f"""SELECT context, item, category, split_part(o, '|', 1) AS level, split_part(o, '|', 2) AS reason,
  round(score * CASE WHEN o LIKE 'EXCLUDED%' THEN 0 WHEN o LIKE 'LOW%' THEN 0.5 WHEN o LIKE '%Default%' THEN 0.7 ELSE 1 END, 9) AS adjusted FROM (SELECT *, {SAFE_SQL} AS o FROM enriched_v)""")


def safety_rules():
    item, ctx = F.lower("item_name"), F.lower("context_name")
    out = [P.Rule(r, F.contains(item, F.lit(a)) & F.contains(ctx, F.lit(b)), "EXCLUDED") for a, b, r in SAFETY]
    has = lambda w: F.contains(item, F.lit(w))
    return out + [P.Rule("Best class", has("bolt"), "HIGH"), P.Rule("Ring with a high score", has("ring") & (F.col("score") >= 0.5), "HIGH"),
                  P.Rule("Ring", has("ring"), "MEDIUM"), P.Rule("Needs validation", has("cold"), "LOW"), P.Rule("Default classification", F.lit(True), "MEDIUM")]


def named_top(t):
    return PR.named(top_items(t), t.contexts(), t.items())


def safety(t):
    out = named_top(t).withColumn("o", P.first_match(safety_rules())).select("*", F.col("o.tier").alias("level"), F.col("o.rule").alias("reason"))
    factor = F.when(F.col("level") == "EXCLUDED", 0.0).when(F.col("level") == "LOW", 0.5).when(F.col("reason") == "Default classification", 0.7).otherwise(1.0)
    return out.select("context", "item", "category", "level", "reason", F.round(F.col("score") * factor, 9).alias("adjusted"))


@entry("p8_safety_filter", "SELECT * FROM safety_v")
def _(t):
    return safety(t)


@entry("p9_filter_statistics", "SELECT level, reason, count(*) AS n, count(*) FILTER (level <> 'EXCLUDED') AS kept FROM safety_v GROUP BY 1, 2")
def _(t):
    return safety(t).groupBy("level", "reason").agg(F.count("*").alias("n"), F.count_if(F.col("level") != "EXCLUDED").alias("kept"))


CONFOUND = [("INVERSE_INDICATION", 0.9, [("red", "nation_11", "red causes it"), ("plate", "nation_12", "plate worsens it")]), ("MECHANISM_MISMATCH", 0.85, [("hot", "nation_13", "wrong way")]),
            ("WRONG_PATHWAY", 0.8, [("gear", "nation_14", "other path")]), ("CANCER_TARGET", 0.75, [("widget", "automobile", "other target")])]
CONF_SQL = "CASE " + " ".join(f"WHEN contains(item_name, '{a}') AND contains(context_name, '{b}') THEN '{k}|{s}'" for k, s, rows in CONFOUND for a, b, _ in rows) + """
  WHEN contains(item_name, 'bolt') AND category = 'household' AND NOT contains(item_name, 'new') THEN CASE WHEN trials >= 5 THEN 'CARDIAC_METABOLIC|0.7' ELSE 'CARDIAC_METABOLIC|0.5' END ELSE 'NONE|0' END"""
view("confounding_v", f"""SELECT context, item, split_part(o, '|', 1) AS kind, split_part(o, '|', 2)::DOUBLE AS confidence FROM (
  SELECT *, {CONF_SQL} AS o FROM (SELECT e.*, train_frequency AS trials FROM enriched_v e))""")


def confounding(t):
    freq = t.truth().groupBy("item").agg(F.count("*").alias("trials"))
    df = named_top(t).join(freq, "item", "left")
    rules = [P.Rule(str(s), F.contains(F.lower("item_name"), F.lit(a)) & F.contains(F.lower("context_name"), F.lit(b)), k) for k, s, rows in CONFOUND for a, b, _ in rows]
    cardiac = F.contains("item_name", F.lit("bolt")) & (F.col("category") == "household") & ~F.contains("item_name", F.lit("new"))
    rules += [P.Rule("0.7", cardiac & (F.col("trials") >= 5), "CARDIAC_METABOLIC"), P.Rule("0.5", cardiac, "CARDIAC_METABOLIC"), P.Rule("0", F.lit(True), "NONE")]
    o = P.first_match(rules)
    return df.select("context", "item", o.getField("tier").alias("kind"), o.getField("rule").cast("double").alias("confidence"))


@entry("p10_confounding", "SELECT * FROM confounding_v")
def _(t):
    return confounding(t)


@entry("p11_confounding_scan", "SELECT kind, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM confounding_v), 4) AS pct FROM confounding_v GROUP BY 1")
def _(t):
    return PR.share_by(confounding(t), "kind")


@entry("p12_biologic_infix", """
  SELECT item, context, target, target IS NULL OR (target = 'joint' AND category IN ('furniture', 'building')) OR (target = 'toy' AND category = 'household') OR (target = 'special' AND category = 'machinery') AS compatible FROM (
    SELECT item, context, category, CASE WHEN item_name = 'red widget' THEN 'special' WHEN ends_with(item_name, 't') THEN
      CASE WHEN contains(right(left(item_name, length(item_name) - 1), 6), 'bol') THEN 'joint' WHEN contains(right(left(item_name, length(item_name) - 1), 6), 'widg') THEN 'toy' ELSE 'unknown' END END AS target FROM enriched_v)""")
def _(t):
    df = named_top(t).withColumn("name", F.col("item_name"))
    return P.biologic_check(df, "t", {"bol": "joint", "widg": "toy"}, {"red widget": "special"}, {"joint": ["furniture", "building"], "toy": ["household"], "special": ["machinery"]}).select(
        "item", "context", "target", "compatible")


@entry("p13_base_complication", "SELECT context, item, base_to_comp, transfer FROM enriched_v")
def _(t):
    w = words()
    named = t.truth().join(t.contexts().select("context", F.col("name").alias("context_name")), "context")
    return P.base_and_complication(named_top(t).select("context", "item", "context_name"), named, w.complications, w.transfer).drop("context_name")


@entry("p14_domain_isolation", "SELECT v.context, v.item, i.only_category IS NOT NULL AND i.only_category <> c.category AS isolated FROM top_v v JOIN contexts_v c USING (context) LEFT JOIN isolated_v i USING (item)")
def _(t):
    return named_top(t).join(P.isolated_items(t.truth(), t.categories()), "item", "left").select(
        "context", "item", F.coalesce(F.col("only_category") != F.col("category"), F.lit(False)).alias("isolated"))


BROAD = {"anvils": ["anvil"], "reds": ["red ring", "red rod"]}
view("broad_v", """
  SELECT e.context, e.item, e.cls IS NOT NULL AND coalesce(m.n, 0) <= 1 AS isolated FROM (
    SELECT *, CASE WHEN contains(item_name, 'anvil') THEN 'anvils' WHEN regexp_matches(item_name, '(red ring|red rod)') THEN 'reds' END AS cls FROM enriched_v) e
  LEFT JOIN (SELECT context, cls, count(DISTINCT item_name) AS n FROM (SELECT context, item_name, unnest([CASE WHEN contains(item_name, 'anvil') THEN 'anvils' END, CASE WHEN regexp_matches(item_name, '(red ring|red rod)') THEN 'reds' END]) AS cls FROM enriched_v)
    WHERE cls IS NOT NULL GROUP BY 1, 2) m ON m.context = e.context AND m.cls = e.cls""")


@entry("p15_broad_class_isolation", "SELECT * FROM broad_v")
def _(t):
    return P.broad_class_isolated(named_top(t), BROAD).select("context", "item", "isolated")


@entry("p16_class_coherence_and_mismatch", """
  SELECT context, item, coherent, (code = 'PROMO' AND category = 'building') OR (code = 'SMALL' AND category = 'machinery') AS mismatch FROM enriched_v""")
def _(t):
    w = words()
    return named_top(t).select("context", "item", P.class_coherent(F.array("code"), F.col("category"), w.coherent).alias("coherent"),
                               P.mismatch(F.col("code"), F.col("category"), w.zero_pairs).alias("mismatch"))


@entry("p17_activity_mismatch", """
  SELECT context, item, need IS NOT NULL AND (contains(item_name, 'hot') OR contains(item_name, 'cold')) AND NOT ((need = 'heat' AND contains(item_name, 'hot')) OR (need = 'chill' AND contains(item_name, 'cold')))
    AND NOT (item_name = 'hot bolt' AND context_name = 'household nation_3') AS mismatch FROM enriched_v""")
def _(t):
    w = words()
    m = P.activity_mismatch(F.col("item_name"), F.col("context_name"), w.activity, w.needed, w.activity_exempt)
    return named_top(t).select("context", "item", F.coalesce(m, F.lit(False)).alias("mismatch"))


ELIGIBLE = ["cancer_same_type_mech_rank10", "household_hierarchy_low", "incoherent_demotion"]
BLOCKED = ["incoherent_demotion", "antimicrobial_pathogen_mismatch", "local_anesthetic_procedural", "default_nomech_low_score"]
view("literature_v", """
  SELECT i.name AS item_name, c.category, CASE WHEN count(*) >= 70 THEN 'STRONG_EVIDENCE' WHEN count(*) < 45 THEN 'WEAK_EVIDENCE' ELSE 'MODERATE_EVIDENCE' END AS lit
  FROM truth_extra_v JOIN contexts_v c USING (context) JOIN items_v i USING (item) GROUP BY 1, 2""")


def literature(t):
    n = F.count("*")
    return t.truth("A").join(t.categories(), "context").join(t.items().select("item", F.col("name").alias("item_name")), "item").groupBy("item_name", "category").agg(
        F.when(n >= 70, "STRONG_EVIDENCE").when(n < 45, "WEAK_EVIDENCE").otherwise("MODERATE_EVIDENCE").alias("lit"))


def _step(n, src, cond, tier, rule):
    r = f"CASE WHEN {cond} THEN {rule} ELSE rule END" if rule else "rule"
    view(n, f"SELECT * EXCLUDE (tier, rule), CASE WHEN {cond} THEN '{tier}' ELSE tier END AS tier, {r} AS rule FROM {src}")


view("moved_0v", """SELECT t.*, tr.item IS NOT NULL AS in_translation, l.lit FROM tiered_v t LEFT JOIN translation_v tr ON tr.context = t.context AND tr.item = t.item
  LEFT JOIN literature_v l ON l.item_name = t.item_name AND l.category = t.category""")
_step("moved_1v", "moved_0v", "tier = 'HIGH' AND overlap >= 2 AND rule IN (" + ", ".join(f"'{x}'" for x in ELIGIBLE) + ")", "GOLDEN", None)
_step("moved_2v", "moved_1v", "tier = 'LOW' AND overlap >= 1 AND category NOT IN ('building') AND coalesce(rule, '') NOT IN (" + ", ".join(f"'{x}'" for x in BLOCKED) + ")", "MEDIUM", "coalesce(rule, 'target_overlap_promotion')")
_step("moved_3v", "moved_2v", "tier = 'MEDIUM' AND category IN ('furniture', 'automobile') AND contains(item_name, 'plate')", "HIGH", "'corticosteroid_soc_promotion'")
_step("moved_4v", "moved_3v", "tier = 'MEDIUM' AND category = 'household' AND contains(item_name, 'plate')", "LOW", "'hematological_corticosteroid_demotion'")
_step("moved_5v", "moved_4v", "tier = 'MEDIUM' AND in_translation AND NOT contains(item_name, 'plate') AND (mechanism OR rank <= 5)", "HIGH", "'transe_medium_promotion'")
_step("moved_6v", "moved_5v", "tier = 'MEDIUM' AND coalesce(lit, '') = 'STRONG_EVIDENCE'", "HIGH", "'literature_strong_promotion'")
_step("moved_7v", "moved_6v", "tier = 'MEDIUM' AND coalesce(lit, '') IN ('WEAK_EVIDENCE', 'NO_EVIDENCE')", "LOW", "'literature_weak_demotion'")


def moves():
    tier, rule, cat = F.col("tier"), F.coalesce("rule", F.lit("")), F.col("category")
    plate = F.contains("item_name", F.lit("plate"))
    medium = tier == "MEDIUM"
    return [
        P.Move((tier == "HIGH") & (F.col("overlap") >= 2) & rule.isin(*ELIGIBLE), "GOLDEN", None),
        P.Move((tier == "LOW") & (F.col("overlap") >= 1) & ~cat.isin("building") & ~rule.isin(*BLOCKED), "MEDIUM", "target_overlap_promotion", keep_rule=True),
        P.Move(medium & cat.isin("furniture", "automobile") & plate, "HIGH", "corticosteroid_soc_promotion"),
        P.Move(medium & (cat == "household") & plate, "LOW", "hematological_corticosteroid_demotion"),
        P.Move(medium & F.col("in_translation") & ~plate & (F.col("mechanism") | (F.col("rank") <= 5)), "HIGH", "transe_medium_promotion"),
        P.Move(medium & (F.col("lit") == "STRONG_EVIDENCE"), "HIGH", "literature_strong_promotion"),
        P.Move(medium & F.col("lit").isin("WEAK_EVIDENCE", "NO_EVIDENCE"), "LOW", "literature_weak_demotion"),
    ]


def moved(t, base=None):
    tr = translation(t).select("context", "item", F.lit(True).alias("in_translation"))
    df = (tiered(t) if base is None else base).join(tr, ["context", "item"], "left").withColumn("in_translation", F.coalesce("in_translation", F.lit(False)))
    return P.apply_moves(df.join(literature(t), ["item_name", "category"], "left"), moves())


@entry("p18_sequential_moves", "SELECT context, item, tier, rule FROM moved_7v")
def _(t):
    return moved(t).select("context", "item", "tier", "rule")


view("status_v", """SELECT context, item, CASE WHEN known THEN 'KNOWN_INDICATION' WHEN gap IS NOT NULL THEN 'LIKELY_GT_GAP' ELSE 'NOVEL' END AS status, CASE WHEN NOT known THEN gap END AS standard_class FROM (
  SELECT e.context, e.item, t.item IS NOT NULL AS known, CASE WHEN contains(item_name, 'bolt') AND category IN ('furniture', 'building') THEN 'bolts' WHEN contains(item_name, 'hot') AND category = 'household' THEN 'heaters' END AS gap
  FROM enriched_v e LEFT JOIN truth_v t ON t.context = e.context AND t.item = e.item)""")
STANDARD = {"bolts": ("bolt", ["furniture", "building"]), "heaters": ("hot", ["household"])}


def with_known(t, df):
    return df.join(t.truth().withColumn("known", F.lit(True)), ["context", "item"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


@entry("p19_literature_status", "SELECT * FROM status_v")
def _(t):
    return P.literature_status(with_known(t, named_top(t)), STANDARD).select("context", "item", "status", "standard_class")


@entry("p20_rule_shadow_audit", f"SELECT context, item, {TIER_HITS} AS n_rules, tier, rule, (CASE WHEN rule IS NULL AND tier = 'LOW' AND ({TIER_HITS}) = 0 THEN 0 ELSE ({TIER_HITS}) - 1 END) AS n_shadowed FROM tiered_v")
def _(t):
    m = P.all_matches(TI.tier_rules(words()))
    df = enriched(t).withColumn("m", m).withColumn("o", P.first_match(TI.tier_rules(words()), "LOW"))
    return df.select("context", "item", F.size("m").alias("n_rules"), F.col("o.tier").alias("tier"), F.col("o.rule").alias("rule"), F.greatest(F.size("m") - 1, F.lit(0)).alias("n_shadowed"))


@entry("p21_approved_and_withdrawn_flags", """
  SELECT e.context, e.item, EXISTS (SELECT 1 FROM approved_v a WHERE a.item_name = e.item_name AND (contains(e.context_name, a.use) OR contains(a.use, e.context_name))) AS approved,
    regexp_matches(e.item_name, '^(old (rod|gizmo))') AS withdrawn FROM enriched_v e""")
def _(t):
    from loomgraph.operators.names import either_contains

    approved = t.truth("A").join(t.items().where("size = 1").select("item", F.col("name").alias("item_name")), "item").join(t.categories(), "context").select(
        "item_name", F.concat(F.col("category"), F.lit(" nation_2")).alias("use")).distinct()
    df = named_top(t)
    match = either_contains(df.select("context_name"), "context_name", approved.select("use"), "use", 5, short=True)
    ok = approved.join(match, "use").select("item_name", "context_name").distinct().withColumn("approved", F.lit(True))
    return df.join(ok, ["item_name", "context_name"], "left").select("context", "item", F.coalesce("approved", F.lit(False)).alias("approved"), F.col("item_name").rlike("^(old (rod|gizmo))").alias("withdrawn"))


view("approved_v", "SELECT DISTINCT i.name AS item_name, c.category || ' nation_2' AS use FROM truth_extra_v JOIN items_v i USING (item) JOIN contexts_v c USING (context) WHERE i.size = 1")


@entry("p22_subtype_rule_match", """
  SELECT context, item, subtype, CASE subtype WHEN 'seating' THEN contains(item_name, 'plate') WHEN 'motor' THEN regexp_matches(item_name, '(gear|rod)') ELSE false END AS recommended FROM (
    SELECT *, CASE WHEN regexp_matches(context_name, 'furniture nation_[1-5]') THEN 'seating' WHEN regexp_matches(context_name, '(automobile|machinery)') THEN 'motor' ELSE 'none' END AS subtype FROM enriched_v)""")
def _(t):
    sub = P.pattern_type(F.col("context_name"), [("seating", "furniture nation_[1-5]"), ("motor", "(automobile|machinery)")], "none")
    df = named_top(t).withColumn("subtype", sub)
    rec = F.when(F.col("subtype") == "seating", F.contains("item_name", F.lit("plate"))).when(F.col("subtype") == "motor", F.col("item_name").rlike("(gear|rod)")).otherwise(F.lit(False))
    return df.select("context", "item", "subtype", rec.alias("recommended"))


view("members_v", "SELECT c.context, i.item, i.name AS item_name FROM contexts_v c JOIN items_v i ON i.name IN ('new gear', 'new bolt') WHERE c.category = 'household' AND c.context IN (SELECT context FROM vectors_v)")
view("short_v", "SELECT * FROM tiered_v WHERE tier <> 'FILTER'")
view("injected_v", """
  WITH new AS (SELECT m.context, m.item, m.item_name, coalesce(f.train_frequency, 0) AS freq FROM members_v m LEFT JOIN frequency_v f USING (item)
      WHERE NOT EXISTS (SELECT 1 FROM short_v s WHERE s.context = m.context AND s.item = m.item)),
    best AS (SELECT context, max(score) AS best FROM top_v GROUP BY 1), have AS (SELECT context, count(*) AS n FROM short_v GROUP BY 1),
    added AS (SELECT n.context, n.item, round(b.best * 0.5 * (1 + n.freq / 100), 6) AS score, row_number() OVER (PARTITION BY n.context ORDER BY n.freq DESC, n.item_name, n.item) AS r, coalesce(h.n, 0) AS have
      FROM new n JOIN best b USING (context) LEFT JOIN have h USING (context)),
    joint AS (SELECT context, item, score, tier, false AS injected FROM short_v UNION ALL SELECT context, item, score, 'MEDIUM', true FROM added WHERE r <= 30 - have)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY list_position(['GOLDEN', 'HIGH', 'MEDIUM', 'LOW', 'FILTER'], tier), score DESC, item) AS rank FROM joint) WHERE rank <= 30""")


def household_members(t):
    return t.vectors().select("context").join(t.categories().where("category = 'household'"), "context").select("context").withColumn(
        "item_name", F.explode(F.array(F.lit("new gear"), F.lit("new bolt")))).join(t.items().select("item", F.col("name").alias("item_name")), "item_name")


@entry("p23_class_injection", "SELECT context, item, score, tier, injected, rank FROM injected_v")
def _(t):
    df = tiered(t)
    best = df.groupBy("context").agg(F.max("score").alias("best_score"))
    freq = t.truth().groupBy("item").agg(F.count("*").alias("train_frequency"))
    return P.inject_class_members(df.where("tier <> 'FILTER'"), household_members(t), freq, best, 30)


LEVELS = [("furniture", "seat", 3, "furniture nation_1"), ("furniture", "seat", 2, "furniture nation_2"), ("furniture", "seat", 1, "furniture"), ("machinery", "engine", 2, "machinery nation_1"), ("machinery", "engine", 1, "machinery")]
view("levels_v", "SELECT context, grp, level FROM (SELECT context, CASE WHEN category = 'furniture' THEN 'seat' WHEN category = 'machinery' THEN 'engine' END AS grp, CASE WHEN contains(name, 'furniture nation_1') THEN 3 WHEN contains(name, 'furniture nation_2') THEN 2 WHEN contains(name, 'machinery nation_1') THEN 2 ELSE 1 END AS level FROM contexts_v) WHERE grp IS NOT NULL")


@entry("p24_specificity_delta", """
  SELECT v.context, v.item, l.grp, l.level - k.known AS delta FROM top_v v JOIN levels_v l USING (context)
  JOIN (SELECT item, grp, max(level) AS known FROM truth_v JOIN levels_v USING (context) GROUP BY 1, 2) k ON k.item = v.item AND k.grp = l.grp""")
def _(t):
    s = P.specificity(F.col("name"), LEVELS)
    levels = t.contexts().select("context", s.alias("s")).where(F.col("s").isNotNull()).select("context", "s.grp", "s.level")
    return P.depth_delta(top_items(t).select("context", "item"), t.truth(), levels).select("context", "item", "grp", "delta")


@entry("p25_word_lists", r"SELECT item, name IN ('red bolt', 'hot rod') AS specific, regexp_matches(name, '(wid|giz)') AS reusable, regexp_matches(name, '\b(rod|red)\b') AS worded FROM items_v")
def _(t):
    flags = P.in_lists(F.col("name"), {"specific": ("equals", ["red bolt", "hot rod"]), "reusable": ("contains", ["wid", "giz"]), "worded": ("word", ["rod", "red"])})
    return t.items().select("item", *[c.alias(n) for n, c in flags.items()])


@entry("p26_probability_bands", "SELECT context, item, CASE WHEN norm_score >= .8 THEN 'Very High' WHEN norm_score >= .6 THEN 'High' WHEN norm_score >= .4 THEN 'Moderate' WHEN norm_score >= .2 THEN 'Low' ELSE 'Very Low' END AS band FROM top_v")
def _(t):
    return top_items(t).select("context", "item", P.probability_band(F.col("norm_score")).alias("band"))


@entry("p27_tier_step", """
  SELECT context, item, ['GOLDEN', 'HIGH', 'MEDIUM', 'LOW', 'FILTER'][least(5, greatest(1, list_position(['GOLDEN', 'HIGH', 'MEDIUM', 'LOW', 'FILTER'], tier) -
    CASE WHEN coherent AND rank <= 5 THEN 1 WHEN NOT coherent AND rank > 10 THEN -1 ELSE 0 END))] AS tier FROM tiered_v""")
def _(t):
    step = F.when(F.col("coherent") & (F.col("rank") <= 5), 1).when(~F.col("coherent") & (F.col("rank") > 10), -1).otherwise(0)
    return tiered(t).select("context", "item", P.shifted_tier(F.col("tier"), step).alias("tier"))


# ---- reports ---------------------------------------------------------------------------
PRECISION = {"GOLDEN": 67.0, "HIGH": 60.8, "MEDIUM": 30.8, "LOW": 14.8, "FILTER": 10.3}
CATEGORY_PRECISION = {"furniture": 55.6, "machinery": 19.5}
PREC_SQL = "CASE WHEN tier = 'MEDIUM' AND category = 'furniture' THEN 55.6 WHEN tier = 'MEDIUM' AND category = 'machinery' THEN 19.5 WHEN tier = 'GOLDEN' THEN 67.0 WHEN tier = 'HIGH' THEN 60.8 WHEN tier = 'MEDIUM' THEN 30.8 WHEN tier = 'LOW' THEN 14.8 ELSE 10.3 END"
BUCKET_SQL = "CASE WHEN rank <= 5 THEN '1-5' WHEN rank <= 10 THEN '6-10' WHEN rank <= 15 THEN '11-15' WHEN rank <= 20 THEN '16-20' WHEN rank <= 25 THEN '21-25' ELSE '26-30' END"
view("final_v", f"""
  SELECT *, {PREC_SQL} AS holdout_precision FROM (
    SELECT m.* EXCLUDE (tier, rule), CASE WHEN b.isolated AND tier IN ('HIGH', 'MEDIUM') THEN 'LOW' ELSE tier END AS tier, CASE WHEN b.isolated AND tier IN ('HIGH', 'MEDIUM') THEN 'broad_class_isolated' ELSE rule END AS rule
    FROM moved_7v m JOIN broad_v b ON b.context = m.context AND b.item = m.item)""")
R_COLS = ["context", "item", "item_name", "context_name", "rank", "score", "norm_score", "tier", "rule", "train_frequency", "mechanism", "overlap", "category", "category_tier", "in_translation", "lit", "holdout_precision"]
R_SQL = ", ".join("round(norm_score, 6) AS norm_score" if c == "norm_score" else c for c in R_COLS)


def final(t):
    """R2: all contexts in one plan."""
    out = P.broad_class_isolated(moved(t), BROAD)
    out = P.apply_moves(out, [P.Move(F.col("isolated") & F.col("tier").isin("HIGH", "MEDIUM"), "LOW", "broad_class_isolated")])
    return out.withColumn("holdout_precision", PR.precision_lookup(F.col("category"), F.col("tier"), CATEGORY_PRECISION, PRECISION))


@entry("r2_batch_predict", f"SELECT {R_SQL} FROM final_v")
def _(t):
    return final(t).withColumn("norm_score", F.round("norm_score", 6)).select(*R_COLS)


@entry("r1_predict_contexts", f"SELECT {R_SQL} FROM final_v WHERE context_name = 'household nation_4' AND tier <> 'FILTER'")
def _(t):
    return PR.of_contexts(final(t), "household nation_4").withColumn("norm_score", F.round("norm_score", 6)).select(*R_COLS)


view("boosted_top_v", VIEWS["top_v"].replace("vote_v", f"""({VIEWS['vote_v'].replace('near_v', 'boosted_near_v')})"""))
view("plan_short_v", f"SELECT * FROM {restated('moved_7v', {'top_v': 'boosted_top_v'}, 'full_')} WHERE tier <> 'FILTER'")
view("plan_injected_v", VIEWS["injected_v"].replace("short_v", "plan_short_v").replace("top_v", "boosted_top_v"))
view("plan_named_v", """
  SELECT j.*, c.name AS context_name, c.category, i.name AS item_name, CASE WHEN j.injected THEN 'class_injection' ELSE m.rule END AS rule FROM plan_injected_v j
  JOIN contexts_v c USING (context) JOIN items_v i USING (item) LEFT JOIN plan_short_v m ON m.context = j.context AND m.item = j.item""")
view("plan_broad_v", VIEWS["broad_v"].replace("enriched_v", "plan_named_v"))


def full_prediction(t):
    """R2 from boosted neighbours (K4), with class members injected (P23) before the broad-class check."""
    near = S.nearest_contexts(t.vectors().join(t.categories(), "context"), t.truth(), 20, boosted=("furniture", "machinery"), boost=0.5)
    top = t.keep("boosted_top", lambda: W.share_of_best(W.top_n(S.vote(near, t.truth()), ["context"], "score", "item", 30), ["context"], "score"))
    df = t.keep("boosted_moved", lambda: moved(t, TI.tiered(enriched(t, top), words())))
    best = top.groupBy("context").agg(F.max("score").alias("best_score"))
    short = df.where("tier <> 'FILTER'")
    out = P.inject_class_members(short, household_members(t), A.frequency(t.truth()), best, 30)
    out = PR.named(out, t.contexts(), t.items()).join(short.select("context", "item", "rule"), ["context", "item"], "left")
    out = P.broad_class_isolated(out.withColumn("rule", F.when(F.col("injected"), "class_injection").otherwise(F.col("rule"))), BROAD)
    out = P.apply_moves(out, [P.Move(F.col("isolated") & F.col("tier").isin("HIGH", "MEDIUM"), "LOW", "broad_class_isolated")])
    return out.withColumn("holdout_precision", PR.precision_lookup(F.col("category"), F.col("tier"), CATEGORY_PRECISION, PRECISION))


FULL = ["context", "item", "item_name", "context_name", "rank", "score", "tier", "rule", "injected", "category", "holdout_precision"]


@entry("r2_full_predict", f"""
  SELECT {', '.join(FULL[:-1])}, {PREC_SQL} AS holdout_precision FROM (
    SELECT f.* EXCLUDE (tier, rule), CASE WHEN b.isolated AND tier IN ('HIGH', 'MEDIUM') THEN 'LOW' ELSE tier END AS tier, CASE WHEN b.isolated AND tier IN ('HIGH', 'MEDIUM') THEN 'broad_class_isolated' ELSE rule END AS rule
    FROM plan_named_v f JOIN plan_broad_v b ON b.context = f.context AND b.item = f.item)""")
def _(t):
    return full_prediction(t).select(*FULL)


@entry("r3_query_by_item", """
  SELECT item, context, score, place FROM (SELECT item, context, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, context) AS place FROM final_v WHERE tier <> 'FILTER') WHERE place <= 10""")
def _(t):
    return W.top_n(final(t).where("tier <> 'FILTER'"), ["item"], "score", "context", 10, "place").select("item", "context", "score", "place")


view("novel_v", """
  SELECT f.*, t.item IS NOT NULL AS known, s.level FROM final_v f LEFT JOIN truth_v t ON t.context = f.context AND t.item = f.item JOIN safety_v s ON s.context = f.context AND s.item = f.item""")


def novel(t):
    return with_known(t, final(t)).join(safety(t).select("context", "item", "level"), ["context", "item"])


@entry("r4_novel_export", "SELECT context, item, tier, score FROM novel_v WHERE tier IN ('GOLDEN', 'HIGH', 'MEDIUM') AND NOT known AND level <> 'EXCLUDED' AND NOT regexp_matches(item_name, '^(old (rod|gizmo))')")
def _(t):
    return PR.novel_rows(novel(t), ["GOLDEN", "HIGH", "MEDIUM"], "^(old (rod|gizmo))").select("context", "item", "tier", "score")


@entry("r4_export_stage_counts", """
  SELECT count(*) AS total, count(*) FILTER (tier IN ('GOLDEN', 'HIGH', 'MEDIUM')) AS in_tier, count(*) FILTER (tier IN ('GOLDEN', 'HIGH', 'MEDIUM') AND NOT known) AS not_known,
    count(*) FILTER (tier IN ('GOLDEN', 'HIGH', 'MEDIUM') AND NOT known AND level <> 'EXCLUDED') AS not_excluded FROM novel_v""")
def _(t):
    tier = F.col("tier").isin("GOLDEN", "HIGH", "MEDIUM")
    new = tier & ~F.col("known")
    return novel(t).agg(F.count("*").alias("total"), F.count_if(tier).alias("in_tier"), F.count_if(new).alias("not_known"), F.count_if(new & (F.col("level") != "EXCLUDED")).alias("not_excluded"))


@entry("r5_clean_deliverable", r"""
  SELECT context, item, item_name, score, place FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY score DESC, item) AS place FROM final_v
    WHERE NOT regexp_matches(lower(item_name), 'db\d+') AND length(item_name) <= 11 AND score >= 0.2) WHERE place <= 10""")
def _(t):
    from loomgraph.operators.names import proper_name

    ok = final(t).where(proper_name(F.col("item_name"), [r"DB\d+"], 11) & (F.col("score") >= 0.2))
    return W.top_n(ok, ["context"], "score", "item", 10, "place").select("context", "item", "item_name", "score", "place")


QUALITY = "round(0.4 * norm_score + 0.3 * least(overlap, 5) / 5 + 0.2 * CASE WHEN mechanism THEN 1 ELSE 0 END + 0.1 * CASE WHEN in_translation THEN 1 ELSE 0 END, 6)"


def quality():
    flag = lambda c: F.col(c).cast("int")
    return F.round(0.4 * F.col("norm_score") + 0.3 * F.least("overlap", F.lit(5)) / 5 + 0.2 * flag("mechanism") + 0.1 * flag("in_translation"), 6)


@entry("r6_full_deliverable", f"""
  SELECT f.context, f.item, f.tier, f.rule, f.holdout_precision, f.overlap, f.lit, s.status, {BUCKET_SQL} AS bucket, {QUALITY} AS quality, x.expected FROM final_v f JOIN status_v s ON s.context = f.context AND s.item = f.item
  LEFT JOIN (SELECT context, round(count(DISTINCT t.item) / count(DISTINCT a.item), 6) AS expected FROM (SELECT context, item FROM truth_v UNION SELECT context, item FROM truth_extra_v) a LEFT JOIN truth_v t USING (context, item) GROUP BY 1) x ON x.context = f.context""")
def _(t):
    done = PR.truth_completeness(t.truth(), t.truth().unionByName(t.truth("A")).distinct()).select("context", F.col("completeness").alias("expected"))
    df = P.literature_status(with_known(t, final(t)), STANDARD).join(done, "context", "left")
    return df.select("context", "item", "tier", "rule", "holdout_precision", "overlap", "lit", "status", W.rank_bucket(F.col("rank")).alias("bucket"), quality().alias("quality"), "expected")


@entry("r7_quality_quartile", """
  SELECT context, item, CASE WHEN in_translation AND mechanism THEN 'Q1' WHEN in_translation OR (mechanism AND rank <= 10) THEN 'Q2' WHEN mechanism OR rank <= 10 THEN 'Q3' ELSE 'Q4' END AS quality FROM final_v WHERE tier = 'MEDIUM'""")
def _(t):
    return final(t).where("tier = 'MEDIUM'").select("context", "item", PR.quality_quartile(F.col("in_translation"), F.col("mechanism"), F.col("rank")).alias("quality"))


@entry("r8_precision_lookup", f"SELECT DISTINCT category, tier, {PREC_SQL} AS precision_pct FROM tiered_v")
def _(t):
    return tiered(t).select("category", "tier").distinct().withColumn("precision_pct", PR.precision_lookup(F.col("category"), F.col("tier"), CATEGORY_PRECISION, PRECISION))


@entry("r9_priority_list", """
  SELECT context, item, CASE WHEN tier = 'GOLDEN' OR (tier = 'HIGH' AND coherent) THEN 1 WHEN tier = 'HIGH' OR (tier = 'MEDIUM' AND coherent) THEN 2 ELSE 3 END AS priority FROM novel_v WHERE NOT known AND tier IN ('GOLDEN', 'HIGH', 'MEDIUM')""")
def _(t):
    df = with_known(t, final(t)).where(~F.col("known") & F.col("tier").isin("GOLDEN", "HIGH", "MEDIUM"))
    return df.select("context", "item", PR.priority(F.col("tier"), F.col("coherent")).alias("priority"))


@entry("r10_result_summary", "SELECT context, tier, count(*) AS n, round(avg(score), 9) AS mean_score, min(rank) AS best_rank, count(*) FILTER (mechanism) AS n_mechanism FROM final_v GROUP BY 1, 2")
def _(t):
    return PR.result_summary(final(t))


@entry("r11_work_status", """
  SELECT event_type, count(*) AS n, arg_min(event_id, (ts, event_id)) AS next_id FROM events GROUP BY 1""")
def _(t):
    return PR.work_status(t.raw("events"), "event_type", ["ts", "event_id"], "event_id")
