"""F, X and L entries: fusion, features and evidence."""

from pyspark.sql import functions as F

from loomgraph.catalog.base import entry, view
from loomgraph.catalog.graph import mechanism, mechanism_of_vectors as mech_of_vectors
from loomgraph.catalog.ingest import side_effects
from loomgraph.catalog.similarity import fingerprint_best, near, top_items, translation, truth_pairs_with_vectors
from loomgraph.catalog.tiering import named_top
from loomgraph.functions import vectors as V
from loomgraph.functions.hashing import seeded_hash
from loomgraph.functions.text import loose_match
from loomgraph.operators import evidence as L
from loomgraph.operators import features as X
from loomgraph.operators import fuse as FU
from loomgraph.operators import names as N
from loomgraph.plans import predict as PR
from loomgraph.session import cut_lineage

WEIGHTS = {"knn": 2.0, "mechanism": 1.0, "translation": 0.5}
view("models_v", """
  SELECT 'knn' AS model, context, item, score, rank FROM top_v UNION ALL SELECT 'mechanism', context, item, score::DOUBLE, rank FROM mechanism_v
  UNION ALL SELECT 'translation', context, item, score, rank FROM translation_v""")
W_SQL = "CASE model WHEN 'knn' THEN 2.0 WHEN 'translation' THEN 0.5 ELSE 1.0 END"


def fused_sql(src):
    return f"""SELECT context, item, round(avg(score), 9) AS mean, round(sum(({W_SQL})::DOUBLE * score) / sum(({W_SQL})::DOUBLE), 9) AS weighted_mean, max(score) AS max, round(median(score), 9) AS median,
      round(avg(greatest(0, n - rank + 1)), 9) AS borda, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS reciprocal, round(count(*) / 3, 9) AS agreement, max(rank) AS worst_rank
    FROM (SELECT *, count(*) OVER (PARTITION BY model, context) AS n FROM {src}) GROUP BY 1, 2"""


view("fused_v", fused_sql("models_v"))


def kept_mechanism(t):
    """The ranking by shared features, written once: a fusion reads it several times."""
    return t.keep("mechanism", lambda: mechanism(t))


def models(t):
    return {"knn": top_items(t), "mechanism": mechanism(t), "translation": translation(t)}


def fused(t):
    return FU.fused_scores(FU.united(models(t)), 3, WEIGHTS)


@entry("f1_mean_weighted_max_median", "SELECT context, item, mean, weighted_mean, max, median, agreement FROM fused_v")
def _(t):
    return fused(t).select("context", "item", "mean", "weighted_mean", "max", "median", "agreement")


@entry("f2_borda", "SELECT context, item, borda FROM fused_v")
def _(t):
    return fused(t).select("context", "item", "borda")


@entry("f3_reciprocal_rank", "SELECT context, item, reciprocal FROM fused_v")
def _(t):
    return fused(t).select("context", "item", "reciprocal")


view("mech_v", "SELECT * FROM mechanism_v WHERE context IN (SELECT context FROM vectors_v)")


view("min_rank_v", """
  SELECT *, row_number() OVER (PARTITION BY context ORDER BY min_rank, score DESC, item) AS rank FROM (
    SELECT context, item, least(coalesce(r1, n + 100), coalesce(r2, n + 100)) AS min_rank, round(greatest(coalesce(s1, 0) / m1, coalesce(CASE WHEN m2 > 0 THEN coalesce(s2, 0) / m2 END, 0)), 9) AS score FROM (
      SELECT *, count(*) OVER (PARTITION BY context) AS n, max(s1) OVER (PARTITION BY context) AS m1, max(s2) OVER (PARTITION BY context) AS m2 FROM (
        SELECT coalesce(a.context, b.context) AS context, coalesce(a.item, b.item) AS item, a.rank AS r1, a.score AS s1, b.rank AS r2, b.score AS s2 FROM top_v a FULL JOIN mech_v b ON a.context = b.context AND a.item = b.item)))""")


@entry("f4_min_rank", "SELECT * FROM min_rank_v")
def _(t):
    return FU.min_rank(top_items(t), mech_of_vectors(t))


JOINED = "(SELECT coalesce(a.context, b.context) AS context, coalesce(a.item, b.item) AS item, {0} FROM {1} a FULL JOIN {2} b ON a.context = b.context AND a.item = b.item)"


@entry("f5_weighted_rank_fusion", f"""
  SELECT j.context, j.item, round(-(0.6 * coalesce(r1, n1, 0) + 0.4 * coalesce(r2, n2, 0)), 9) AS score FROM {JOINED.format('a.rank - 1 AS r1, b.rank - 1 AS r2', 'top_v', 'mechanism_v')} j
  LEFT JOIN (SELECT context, count(*) AS n1 FROM top_v GROUP BY 1) x USING (context) LEFT JOIN (SELECT context, count(*) AS n2 FROM mechanism_v GROUP BY 1) y USING (context)""")
def _(t):
    return FU.rank_fusion(top_items(t), kept_mechanism(t), 0.6)


def scaled_sql(src):
    return f"(SELECT context, item, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.5 END AS s FROM (SELECT *, min(score) OVER (PARTITION BY context) AS lo, max(score) OVER (PARTITION BY context) AS hi FROM {src}))"


@entry("f6_min_max_score_fusion", f"SELECT context, item, round(0.7 * coalesce(s1, 0) + 0.3 * coalesce(s2, 0), 9) AS score FROM {JOINED.format('a.s AS s1, b.s AS s2', scaled_sql('top_v'), scaled_sql('mechanism_v'))}")
def _(t):
    return FU.score_fusion(top_items(t), kept_mechanism(t), 0.7)


@entry("f7_consensus_filters", """
  SELECT 'agreement' AS filter, context, item FROM fused_v WHERE agreement >= 0.5 UNION ALL SELECT 'unanimous', context, item FROM fused_v WHERE agreement >= 1
  UNION ALL SELECT 'within', context, item FROM fused_v WHERE agreement >= 1 AND worst_rank <= 20""")
def _(t):
    f = cut_lineage(fused(t).drop("model_scores"))
    pick = lambda n, d: d.select(F.lit(n).alias("filter"), "context", "item")
    return pick("agreement", FU.consensus(f, 0.5)).union(pick("unanimous", FU.consensus(f, unanimous=True))).union(pick("within", FU.consensus(f, all_within=20)))


view("calibrated_v", """
  SELECT model, context, item, rank, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.5 END AS score, 1 / (1 + exp(-(score - m) / CASE WHEN s > 0 THEN s ELSE 1 END)) AS z FROM (
    SELECT *, min(score) OVER (PARTITION BY model) AS lo, max(score) OVER (PARTITION BY model) AS hi, avg(score) OVER (PARTITION BY model) AS m, stddev_pop(score) OVER (PARTITION BY model) AS s FROM models_v)""")


@entry("f8_score_calibration", "SELECT model, context, item, round(score, 6) AS scaled, round(z, 6) AS sigmoid FROM calibrated_v")
def _(t):
    p = FU.stacked(models(t))
    z = FU.calibrated(FU.calibrated(p, "minmax").withColumnRenamed("calibrated", "scaled"), "zscore")
    return z.select("model", "context", "item", F.round("scaled", 6).alias("scaled"), F.round("calibrated", 6).alias("sigmoid"))


@entry("f9_category_routing", """
  SELECT context, item, min(rank) AS rank, arg_min(model, (rank, model)) AS model FROM (
    SELECT m.*, CASE category WHEN 'furniture' THEN 'knn' WHEN 'machinery' THEN 'mechanism' END AS target FROM models_v m JOIN contexts_v USING (context)) WHERE target IS NULL OR target = model GROUP BY 1, 2""")
def _(t):
    return FU.routed(FU.united(models(t)), t.categories(), {"furniture": "knn", "machinery": "mechanism"})


@entry("f10_multiplicative_boosts", """
  SELECT e.context, e.item, round(e.score * (1 + 0.01 * least(overlap, 10)), 9) AS by_overlap, round(e.score * (1 + 0.01 * least(overlap, 10)) * (1 + 0.1 * CASE WHEN coherent THEN 1 ELSE 0 END), 9) AS by_overlap_and_class,
    round(e.score * (1 + 0.2 * coalesce(b.best, 0)), 9) AS by_similarity, round(e.score * (1 + 0.01 * least(overlap, 10)) * (1 + 0.1 * CASE WHEN coherent THEN 1 ELSE 0 END) * (1 + 0.2 * coalesce(b.best, 0)), 9) AS by_all
  FROM enriched_v e LEFT JOIN fingerprint_best_v b ON b.context = e.context AND b.item = e.item""")
def _(t):
    from loomgraph.catalog.tiering import enriched

    sim = fingerprint_best(t).select("context", "item", "best")
    df = enriched(t).join(sim, ["context", "item"], "left")
    s, o, c, b = F.col("score"), F.col("overlap"), F.col("coherent").cast("int"), F.coalesce("best", F.lit(0.0))
    return df.select("context", "item", F.round(FU.boosted(s, o), 9).alias("by_overlap"), F.round(FU.boosted(s, o, relevance=c), 9).alias("by_overlap_and_class"),
                     F.round(FU.boosted(s, similarity=b), 9).alias("by_similarity"), F.round(FU.boosted(s, o, relevance=c, similarity=b), 9).alias("by_all"))


@entry("f11_composite_score", "SELECT v.context, v.item, round(score * (1 + 0.1 * least(n_shared, 20)) * CASE WHEN rank <= 10 THEN 1 ELSE 0.8 END, 9) AS composite FROM top_v v JOIN shared_v s ON s.context = v.context AND s.item = v.item")
def _(t):
    df = X.target_features(top_items(t), t.item_features(), t.context_features())
    return df.select("context", "item", F.round(FU.composite(F.col("score"), F.col("overlap"), F.col("rank") <= 10), 9).alias("composite"))


@entry("f12_probability_combination", """
  SELECT context, item, round((p + q) / 2, 9) AS mean, round((0.7 * p + 0.3 * q) / 1.0, 9) AS weighted, round(2 / (1 / greatest(p, 0.001) + 1 / greatest(q, 0.001)), 9) AS harmonic, greatest(p, q) AS max, least(p, q) AS min
  FROM (SELECT context, item, norm_score AS p, 1 - (rank - 1) / 30 AS q FROM top_v)""")
def _(t):
    c = FU.combined_probability([F.col("norm_score"), 1 - (F.col("rank") - 1) / 30], [0.7, 0.3])
    return top_items(t).select("context", "item", *[(F.round(v, 9) if k not in ("max", "min") else v).alias(k) for k, v in c.items()])


@entry("f14_agreement_tier", """
  SELECT context, item, round((s1 + s2) / 2, 9) AS score, CASE WHEN s1 > 0.6 AND s2 > 0.6 THEN 1 WHEN s1 > 0.5 OR s2 > 0.5 THEN 2 ELSE 3 END AS tier FROM (
    SELECT coalesce(a.context, b.context) AS context, coalesce(a.item, b.item) AS item, coalesce(a.norm_score, 0) AS s1, coalesce(b.p, 0) AS s2 FROM top_v a FULL JOIN (SELECT context, item, 1 / (1 - score) AS p FROM translation_v) b ON a.context = b.context AND a.item = b.item)""")
def _(t):
    a = top_items(t).select("context", "item", F.col("norm_score").alias("score"))
    b = translation(t).select("context", "item", (1 / (1 - F.col("score"))).alias("score"))
    return FU.agreement_tier(a, b)


view("cal_fused_v", fused_sql("calibrated_v"))


@entry("f15_ensemble_pipeline", """
  SELECT context, item, reciprocal AS score, agreement, rank FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY reciprocal DESC, item) AS rank FROM cal_fused_v WHERE agreement >= 0.5) WHERE rank <= 30""")
def _(t):
    return FU.ensemble(models(t), WEIGHTS)


# ---- features --------------------------------------------------------------------------
@entry("x1_target_features", """
  SELECT s.context, s.item, n_shared AS overlap, coalesce(a.n, 0) AS n_item_features, coalesce(b.n, 0) AS n_context_features, CASE WHEN a.n > 0 THEN round(n_shared / a.n, 6) ELSE 0 END AS overlap_share, CASE WHEN n_shared > 0 THEN 1 ELSE 0 END AS has_overlap
  FROM shared_v s LEFT JOIN (SELECT item, count(*) AS n FROM item_features_v GROUP BY 1) a USING (item) LEFT JOIN (SELECT context, count(*) AS n FROM context_features_v GROUP BY 1) b USING (context)""")
def _(t):
    return X.target_features(top_items(t).select("context", "item"), t.item_features(), t.context_features())


@entry("x2_group_features", """
  SELECT s.context, s.item, n_shared AS group_overlap, round(j, 6) AS group_jaccard, round(least(n_shared, 10) * 0.1 + j * 0.5, 6) AS group_score FROM (
    SELECT s.*, CASE WHEN coalesce(a.n, 0) + coalesce(b.n, 0) - n_shared > 0 THEN n_shared / (coalesce(a.n, 0) + coalesce(b.n, 0) - n_shared) ELSE 0 END AS j FROM shared_groups_v s
    LEFT JOIN (SELECT item, count(*) AS n FROM item_groups_v GROUP BY 1) a USING (item) LEFT JOIN (SELECT context, count(*) AS n FROM context_groups_v GROUP BY 1) b USING (context)) s""")
def _(t):
    return X.group_features(top_items(t).select("context", "item"), t.item_features(), t.context_features(), t.feature_groups())


@entry("x3_chemical_features", "SELECT context, item, best, CASE WHEN best > 0.7 THEN 1 ELSE 0 END AS similar, above_70, above_50 FROM fingerprint_best_v")
def _(t):
    return fingerprint_best(t).select("context", "item", "best", (F.col("best") > 0.7).cast("int").alias("similar"), "above_70", "above_50")


@entry("x4_code_features", """
  WITH k AS (SELECT name, min(class1) AS code FROM items_v WHERE size <= 4 GROUP BY 1), f AS (SELECT regexp_replace(name, '[^a-z0-9]', '', 'g') AS n, min(code) AS c1 FROM k GROUP BY 1), s AS (SELECT split_part(name, ' ', 1) AS s, min(code) AS c2 FROM k GROUP BY 1)
  SELECT item, CASE WHEN code IS NULL THEN 0 ELSE 1 END AS has_code, CASE WHEN code IS NULL THEN 0.0 WHEN code IN ('LARGE', 'MEDIUM') THEN 1.0 ELSE 0.5 END AS relevance, CASE WHEN code = 'ECONOMY' THEN 1 ELSE 0 END AS code_economy, CASE WHEN code = 'LARGE' THEN 1 ELSE 0 END AS code_large,
    CASE WHEN code = 'MEDIUM' THEN 1 ELSE 0 END AS code_medium FROM (SELECT item, coalesce(f.c1, s.c2) AS code FROM items_v i LEFT JOIN f ON f.n = regexp_replace(i.name, '[^a-z0-9]', '', 'g') LEFT JOIN s ON s.s = split_part(i.name, ' ', 1))""")
def _(t):
    codes = t.items().where("size <= 4").groupBy("name").agg(F.min("class1").alias("code"))
    return X.code_features(t.items().select("item", "name"), codes, F.col("code").isin("LARGE", "MEDIUM"), ["ECONOMY", "LARGE", "MEDIUM"])


@entry("x5_pair_vectors", """
  SELECT context, item, len(v) AS dims, round(list_sum(v), 6) AS total, round(v[130], 6) AS product_2, round(v[256], 6) AS difference_64 FROM (
    SELECT context, item, list_concat(list_concat(iv, cv), list_concat(list_transform(list_zip(iv, cv), lambda z: z[1] * z[2]), list_transform(list_zip(iv, cv), lambda z: z[1] - z[2]))) AS v FROM truth_vec_v)""")
def _(t):
    v = truth_pairs_with_vectors(t).select("context", "item", X.pair_vector(F.col("iv"), F.col("cv")).alias("v"))
    return v.select("context", "item", F.size("v").alias("dims"), F.round(V.total(F.col("v")), 6).alias("total"), F.round(F.get("v", 129), 6).alias("product_2"), F.round(F.get("v", 255), 6).alias("difference_64"))


view("translated_v", "SELECT context, item, 1 / (1 - score) AS score, rank FROM translation_v")


@entry("x6_model_rank_features", """
  SELECT v.context, v.item, coalesce(round(r.score / m.s, 9), 0) AS score_share, coalesce(round(1 - r.rank / m.r, 9), 0) AS rank_share, CASE WHEN r.rank <= 10 THEN 1 ELSE 0 END AS in_top10, CASE WHEN r.rank <= 30 THEN 1 ELSE 0 END AS in_top30, CASE WHEN r.rank <= 50 THEN 1 ELSE 0 END AS in_top50
  FROM top_v v LEFT JOIN translated_v r ON r.context = v.context AND r.item = v.item LEFT JOIN (SELECT context, max(score) AS s, max(rank) AS r FROM translated_v GROUP BY 1) m ON m.context = v.context""")
def _(t):
    r = translation(t).withColumn("score", 1 / (1 - F.col("score")))
    return X.model_rank_features(top_items(t).select("context", "item"), r)


@entry("x7_prediction_features", """
  SELECT e.context, e.item, round(norm_score, 6) AS norm_score, rank, train_frequency, overlap, CASE WHEN mechanism THEN 1 ELSE 0 END AS mechanism, CASE WHEN has_targets THEN 1 ELSE 0 END AS has_targets,
    CASE WHEN contains(item_name, 'hot') THEN 1 ELSE 0 END AS is_hot, CASE WHEN ends_with(item_name, 'bolt') THEN 1 ELSE 0 END AS is_bolt, CASE WHEN category = 'furniture' THEN 1 ELSE 0 END AS is_furniture FROM enriched_v e""")
def _(t):
    from loomgraph.catalog.tiering import enriched

    i = lambda c: c.cast("int")
    return enriched(t).select("context", "item", F.round("norm_score", 6).alias("norm_score"), "rank", "train_frequency", "overlap", i(F.col("mechanism")).alias("mechanism"), i(F.col("has_targets")).alias("has_targets"),
                              i(F.contains("item_name", F.lit("hot"))).alias("is_hot"), i(F.endswith("item_name", F.lit("bolt"))).alias("is_bolt"), i(F.col("category") == "furniture").alias("is_furniture"))


@entry("x8_one_hot_category", "SELECT context, CASE WHEN category = 'furniture' THEN 1 ELSE 0 END AS category_furniture, CASE WHEN category = 'building' THEN 1 ELSE 0 END AS category_building, 0 AS category_unseen FROM contexts_v")
def _(t):
    return t.categories().select("context", *X.one_hot(F.col("category"), ["furniture", "building", "unseen"], "category"))


@entry("x9_similarity_summary", "SELECT context, max(similarity) AS max_similarity, round(avg(similarity), 9) AS mean_similarity, round(median(similarity), 9) AS median_similarity FROM loo_near_v GROUP BY 1")
def _(t):
    return X.similarity_summary(near(t, exclude_self=True))


# ---- evidence --------------------------------------------------------------------------
view("evidence_v", """
  SELECT user_id, count(*) FILTER (event_type = 'view') AS pubmed_total, count(*) FILTER (event_type = 'click' AND value > 20) AS pubmed_recent, count(*) FILTER (event_type = 'purchase' AND value > 40) AS pubmed_clinical,
    count(*) FILTER (event_type = 'signup' AND value > 30) AS pubmed_review, count(*) FILTER (event_type = 'click' AND value > 40) AS treatment_context, count(*) FILTER (event_type = 'purchase' AND value > 30) AS trial_count,
    coalesce(list_sort(list(DISTINCT 'Phase ' || (k // 25 + 1)) FILTER (event_type = 'purchase' AND value > 30)), []) AS phases,
    coalesce(list_sort(list(DISTINCT CASE WHEN k < 40 THEN 'RECRUITING' WHEN k < 80 THEN 'COMPLETED' ELSE 'UNKNOWN' END) FILTER (event_type = 'purchase' AND value > 30)), []) AS statuses,
    count(*) FILTER (event_type = 'error' AND value > 60) > 0 AS adverse, count(*) FILTER (event_type = 'signup' AND value > 60) > 0 AS confirmed, round(least(count(*) FILTER (event_type = 'error') / 100, 0.9), 6) AS confounding
  FROM (SELECT *, json_extract(props, '$.k')::INT AS k FROM events) GROUP BY 1""")


def evidence(t):
    e = t.raw("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind, v = F.col("event_type"), F.col("value")
    n = lambda c: F.count_if(c)
    trial = (kind == "purchase") & (v > 30)
    status = F.when(F.col("k") < 40, "RECRUITING").when(F.col("k") < 80, "COMPLETED").otherwise("UNKNOWN")
    return e.groupBy("user_id").agg(
        n(kind == "view").alias("pubmed_total"), n((kind == "click") & (v > 20)).alias("pubmed_recent"), n((kind == "purchase") & (v > 40)).alias("pubmed_clinical"), n((kind == "signup") & (v > 30)).alias("pubmed_review"),
        n((kind == "click") & (v > 40)).alias("treatment_context"), n(trial).alias("trial_count"), F.array_sort(F.collect_set(F.when(trial, F.concat(F.lit("Phase "), (F.floor(F.col("k") / 25) + 1).cast("string"))))).alias("phases"),
        F.array_sort(F.collect_set(F.when(trial, status))).alias("statuses"), (n((kind == "error") & (v > 60)) > 0).alias("adverse"), (n((kind == "signup") & (v > 60)) > 0).alias("confirmed"),
        F.round(F.least(n(kind == "error") / 100, F.lit(0.9)), 6).alias("confounding"))


POINTS = """round(CASE WHEN trial_count > 0 THEN CASE WHEN list_contains(phases, 'Phase 3') OR list_contains(phases, 'Phase 4') THEN 4.0 WHEN list_contains(phases, 'Phase 2') THEN 2.5 ELSE 1.0 END ELSE 0 END
  + CASE WHEN pubmed_total >= 20 AND pubmed_clinical > 0 THEN 3.0 WHEN pubmed_total >= 5 THEN 1.5 + CASE WHEN pubmed_recent >= 3 THEN 0.5 ELSE 0 END WHEN pubmed_total >= 1 THEN 0.5 ELSE 0 END
  + CASE WHEN treatment_context >= 5 THEN 1.0 WHEN treatment_context >= 1 THEN 0.3 ELSE 0 END + CASE WHEN pubmed_clinical >= 3 THEN 1.0 ELSE 0 END + CASE WHEN confirmed AND NOT adverse THEN 2.0 ELSE 0 END, 2)::DOUBLE"""
view("levels_of_evidence_v", f"SELECT *, CASE WHEN adverse THEN 'ADVERSE_EFFECT' WHEN points >= 4 THEN 'STRONG_EVIDENCE' WHEN points >= 2 THEN 'MODERATE_EVIDENCE' WHEN points > 0 THEN 'WEAK_EVIDENCE' ELSE 'NO_EVIDENCE' END AS level FROM (SELECT *, {POINTS} AS points FROM evidence_v)")


def levels(t):
    return evidence(t).withColumn("points", L.evidence_points()).withColumn("level", L.evidence_level(F.col("points"), F.col("adverse")))


@entry("l1_evidence_level", "SELECT user_id, points, level FROM levels_of_evidence_v")
def _(t):
    return levels(t).select("user_id", "points", "level")


def _max_weight(col, weights, other):
    case = " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items())
    return f"coalesce(list_max(list_transform({col}, lambda x: (CASE x {case} ELSE {other} END)::DOUBLE)), 0)"


view("validation_v", f"""
  SELECT *, round(validation_raw, 6) AS validation_score, round(validation_raw * (1 - confounding), 6) AS adjusted_score FROM (SELECT *, trial_raw * 0.6 + literature_raw * 0.4 AS validation_raw FROM (
    SELECT *, CASE WHEN trial_count > 0 THEN {_max_weight('phases', L.PHASE_WEIGHTS, L.OTHER_PHASE)} * 0.5 + {_max_weight('statuses', L.STATUS_WEIGHTS, L.OTHER_STATUS)} * 0.3 + least(trial_count / 10, 1) * 0.2 ELSE 0 END AS trial_raw,
      CASE WHEN pubmed_total > 0 THEN least(pubmed_total / 50, 1) * 0.4 + least(pubmed_recent / 20, 0.5) + least(pubmed_review / 5, 0.3) + least(pubmed_clinical / 5, 0.3) ELSE 0 END AS literature_raw FROM evidence_v))""")


def validated(t):
    return evidence(t).withColumns(L.validation_score())


@entry("l2_validation_score", "SELECT user_id, round(trial_raw, 6) AS trial_score, round(literature_raw, 6) AS literature_score, validation_score, adjusted_score FROM validation_v")
def _(t):
    return validated(t).select("user_id", "trial_score", "literature_score", "validation_score", "adjusted_score")


@entry("l3_evidence_report", "SELECT CASE WHEN adjusted_score >= 0.5 THEN 'strong' WHEN adjusted_score >= 0.2 THEN 'moderate' WHEN adjusted_score > 0 THEN 'weak' ELSE 'none' END AS band, count(*) AS n, round(avg(adjusted_score), 6) AS mean_score, max(adjusted_score) AS best FROM validation_v GROUP BY 1")
def _(t):
    return validated(t).groupBy(L.score_band(F.col("adjusted_score")).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("adjusted_score"), 6).alias("mean_score"), F.max("adjusted_score").alias("best"))


@entry("l4_evidence_summary", "SELECT level, count(*) AS n, round(avg(points), 6) AS mean_points, count(*) FILTER (adverse) AS n_adverse FROM levels_of_evidence_v GROUP BY 1")
def _(t):
    return levels(t).groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg("points"), 6).alias("mean_points"), F.count_if("adverse").alias("n_adverse"))


@entry("l5_keyed_upsert", "SELECT context, item, 'stored' AS origin FROM truth_extra_v UNION ALL SELECT context, item, 'new' FROM (SELECT * FROM truth_v EXCEPT SELECT * FROM truth_extra_v)")
def _(t):
    return L.upsert_new(t.truth("A").withColumn("origin", F.lit("stored")), t.truth().withColumn("origin", F.lit("new")), ["context", "item"])


@entry("l5_forced_refresh", """
  SELECT context, item, CASE WHEN bool_or(incoming) AND (context + item) % 3 = 0 THEN 'fresh' WHEN bool_or(stored) THEN 'stored' ELSE 'new' END AS origin
  FROM (SELECT context, item, true AS stored, false AS incoming FROM truth_extra_v UNION ALL SELECT context, item, false, true FROM truth_v) GROUP BY context, item""")
def _(t):
    refresh = (F.col("context") + F.col("item")) % 3 == 0
    incoming = t.truth().withColumn("origin", F.when(refresh, F.lit("fresh")).otherwise(F.lit("new")))
    stored = t.truth("A").withColumn("origin", F.lit("stored"))
    return L.upsert_refreshed(stored, incoming, ["context", "item"], refresh)


TERMS_L, TERMS_R, TREAT = ["the", "of the", "and"], ["de la", "that", "der"], ["with", "para"]
PLAIN = "' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' '"


@entry("l6_corpus_cooccurrence", f"""
  WITH d AS (SELECT d.doc_id, {PLAIN} AS plain, n_chars > 2000 AS recent, coalesce(l.quality, 0) = 1 AS review FROM documents d LEFT JOIN labels l USING (doc_id))
  SELECT l_term, r_term, count(*) AS both_terms, count(*) FILTER (contains(plain, ' with ') OR contains(plain, ' para ')) AS treatment, count(*) FILTER (recent) AS recent, count(*) FILTER (review) AS review
  FROM d, (SELECT unnest(['the', 'of the', 'and']) AS l_term), (SELECT unnest(['de la', 'that', 'der']) AS r_term) WHERE contains(plain, ' ' || l_term || ' ') AND contains(plain, ' ' || r_term || ' ') GROUP BY 1, 2""")
def _(t):
    term = lambda name, ws: t.spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in ws])).alias(name))
    d = t.raw("documents").join(t.raw("labels").select("doc_id", "quality"), "doc_id", "left").select(
        "doc_id", "text", (F.col("n_chars") > 2000).alias("recent"), (F.coalesce("quality", F.lit(0)) == 1).alias("review"))
    return L.cooccurrence(d, term("l_term", TERMS_L), term("r_term", TERMS_R), TREAT)


@entry("l7_adverse_crosscheck", """
  SELECT DISTINCT e.context, e.item, s.term FROM enriched_v e JOIN side_effects_v s ON s.name = e.item_name AND contains(e.context_name, s.term)
  WHERE NOT EXISTS (SELECT 1 FROM truth_v t WHERE t.context = e.context AND t.item = e.item) AND NOT EXISTS (SELECT 1 FROM truth_extra_v t WHERE t.context = e.context AND t.item = e.item)""")
def _(t):
    p = named_top(t)
    effects = cut_lineage(side_effects(t))
    pairs = N.term_pairs(p.select(F.col("context_name").alias("a")), effects.select(F.col("term").alias("b")))
    matches = pairs.where(loose_match(F.col("a"), F.col("b"))).select(F.col("a").alias("context_name"), F.col("b").alias("term"))
    known = t.truth().union(t.truth("A")).distinct()
    return L.adverse_crosscheck(p, effects, matches, known)
