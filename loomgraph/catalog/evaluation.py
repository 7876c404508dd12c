"""E and T entries: hold-out experiments, measures and statistics."""

from pyspark.sql import functions as F

from loomgraph.catalog.base import entry, view
from loomgraph.catalog.graph import mechanism_of_vectors
from loomgraph.catalog.similarity import K_OF, loo_top, near, top_items, votes  # noqa: F401
from loomgraph.catalog.statistics import hits
from loomgraph.functions import vectors as V
from loomgraph.operators import aggregate as A
from loomgraph.operators import evaluate as E
from loomgraph.operators import names as N
from loomgraph.operators import ranking as W
from loomgraph.operators import similar as S
from loomgraph.operators.graph import pair_overlap
from loomgraph.operators.nearest import BLOCK_ROWS, count_better
from loomgraph.operators.pivots import count_better_pruned
from loomgraph.plans import holdout as H
from loomgraph.session import cut_lineage

view("split_v", """
  SELECT seed, context, r <= floor(n * 0.2) AS test FROM (SELECT seed, context, row_number() OVER (PARTITION BY seed ORDER BY ('0x' || substr(md5(seed || ':' || context), 1, 8))::BIGINT, context) AS r, count(*) OVER (PARTITION BY seed) AS n
    FROM train_v, (SELECT unnest([42, 43, 44, 45, 46]) AS seed))""")
view("hold_votes_v", """
  SELECT n.seed, n.context, t.item, round(sum(similarity), 6) AS score FROM (
    SELECT a.seed, p.context, p.neighbour, p.similarity, row_number() OVER (PARTITION BY a.seed, p.context ORDER BY p.similarity DESC, p.neighbour) AS place
    FROM pairs_v p JOIN split_v a ON a.context = p.context AND a.test JOIN split_v b ON b.context = p.neighbour AND b.seed = a.seed AND NOT b.test) n
  JOIN truth_v t ON t.context = n.neighbour WHERE n.place <= 20 GROUP BY 1, 2, 3""")
view("hold_rank_v", "SELECT *, row_number() OVER (PARTITION BY seed, context ORDER BY score DESC, item) AS rank FROM hold_votes_v")
view("hold_hits_v", "SELECT h.*, CASE WHEN t.item IS NULL THEN 0 ELSE 1 END AS hit FROM hold_rank_v h LEFT JOIN truth_v t USING (context, item) WHERE rank <= 100")
view("overlap_v", "SELECT context, item, count(*) AS overlap FROM item_features_v JOIN context_features_v USING (feature) GROUP BY 1, 2")
BASE = """CASE WHEN rank > 20 THEN 'FILTER|rank_over_20' WHEN freq <= 2 AND NOT mech THEN 'FILTER|rare_no_mechanism' WHEN freq >= 15 AND mech THEN 'GOLDEN|freq15_mechanism' WHEN rank <= 5 AND freq >= 10 AND mech THEN 'GOLDEN|rank5_freq10_mechanism'
  WHEN freq >= 10 AND mech THEN 'HIGH|freq10_mechanism' WHEN rank <= 5 AND freq >= 5 THEN 'HIGH|rank5_freq5' WHEN freq >= 5 AND mech THEN 'MEDIUM|freq5_mechanism' WHEN freq >= 10 THEN 'MEDIUM|freq10' ELSE 'LOW|default' END"""
view("hold_tier_v", f"""
  SELECT *, split_part(o, '|', 1) AS tier, split_part(o, '|', 2) AS rule FROM (SELECT *, {BASE} AS o FROM (
    SELECT h.*, coalesce(f.n, 0) AS freq, o.overlap IS NOT NULL AS mech FROM hold_hits_v h LEFT JOIN overlap_v o USING (context, item)
    LEFT JOIN (SELECT seed, item, count(*) AS n FROM truth_v JOIN split_v USING (context) WHERE NOT test GROUP BY 1, 2) f ON f.seed = h.seed AND f.item = h.item WHERE h.rank <= 30))""")
view("full_tier_v", f"""
  SELECT *, split_part(o, '|', 1) AS tier, split_part(o, '|', 2) AS rule FROM (SELECT *, {BASE} AS o FROM (
    SELECT v.context, v.item, v.score, v.rank, CASE WHEN t.item IS NULL THEN 0 ELSE 1 END AS hit, coalesce(f.train_frequency, 0) AS freq, o.overlap IS NOT NULL AS mech FROM top_v v LEFT JOIN truth_v t USING (context, item)
    LEFT JOIN overlap_v o ON o.context = v.context AND o.item = v.item LEFT JOIN frequency_v f ON f.item = v.item))""")
HITS = "count(*) AS n, sum(hit) AS hits, round(avg(hit) * 100, 4) AS precision_pct"


def held(t, top=30):
    ranked, parts = H.holdout_predictions(t.vectors(), t.truth(), top=top)
    return H.with_hits(ranked, t.truth()), parts


def held_tiers(t):
    h, parts = held(t)
    return H.tiered_holdout(cut_lineage(h), H.train_truth(t.truth(), parts), t.item_features(), t.context_features()), parts


def full_tiers(t):
    top = H.with_hits(top_items(t).select("context", "item", "score", "rank"), t.truth())
    return H.tiered_holdout(top, t.truth(), t.item_features(), t.context_features(), by=())


@entry("e1_context_split", "SELECT * FROM split_v")
def _(t):
    return H.split(t.vectors().join(t.truth().select("context").distinct(), "context", "left_semi"))


RECALL = """SELECT seed, count(*) AS n_contexts, round(sum(found) / sum(size), 6) AS micro, round(avg(found / size), 6) AS macro FROM (
  SELECT s.seed, s.context, any_value(z.size) AS size, coalesce(sum(h.hit), 0) AS found FROM split_v s JOIN (SELECT context, count(*) AS size FROM truth_v GROUP BY 1) z USING (context)
  LEFT JOIN {0} h ON h.seed = s.seed AND h.context = s.context AND h.rank <= 30 WHERE s.test GROUP BY 1, 2) GROUP BY 1"""
view("seed_recall_v", RECALL.format("hold_hits_v"))


def seed_recall(t):
    h, parts = held(t)
    return E.recall(h, t.truth(), parts.where("test"), ["seed"])


@entry("e2_seed_mean_and_deviation", "SELECT 'micro' AS measure, count(*) AS n_seeds, round(avg(micro), 4) AS mean, round(stddev_pop(micro), 4) AS std FROM seed_recall_v UNION ALL SELECT 'macro', count(*), round(avg(macro), 4), round(stddev_pop(macro), 4) FROM seed_recall_v")
def _(t):
    long = seed_recall(t).select("seed", F.explode(F.map_from_arrays(F.array(F.lit("micro"), F.lit("macro")), F.array("micro", "macro"))).alias("measure", "v"))
    return H.over_seeds(long, ["measure"], "v")


@entry("e3_train_only_frequency", "SELECT seed, item, count(*) AS train_frequency FROM truth_v JOIN split_v USING (context) WHERE NOT test GROUP BY 1, 2")
def _(t):
    parts = H.split(t.vectors().join(t.truth().select("context").distinct(), "context", "left_semi"))
    return H.train_truth(t.truth(), parts).groupBy("seed", "item").agg(F.count("*").alias("train_frequency"))


@entry("e4_recall_micro_macro", "SELECT * FROM seed_recall_v")
def _(t):
    return seed_recall(t)


view("at_k_v", """
  SELECT k, count(*) AS n, round(avg(found / k), 6) AS precision, round(stddev_pop(found / k), 6) AS precision_std, round(avg(found / size), 6) AS recall, round(stddev_pop(found / size), 6) AS recall_std, round(median(found / size), 6) AS recall_median FROM (
    SELECT seed, h.context, k, any_value(size) AS size, sum(CASE WHEN rank <= k THEN hit ELSE 0 END) AS found FROM hold_hits_v h JOIN (SELECT context, count(*) AS size FROM truth_v GROUP BY 1) z USING (context), (SELECT unnest([10, 20, 30, 50, 100]) AS k) GROUP BY 1, 2, 3) GROUP BY 1""")


def at_k(t):
    return E.precision_recall_at(cut_lineage(held(t, 100)[0]), t.truth(), [10, 20, 30, 50, 100])


@entry("e5_precision_recall_at_k", "SELECT * FROM at_k_v")
def _(t):
    return at_k(t)


@entry("e6_hit_by_category", "SELECT seed, category, count(*) AS n, round(avg(hit), 6) AS hit_rate FROM (SELECT seed, context, max(hit) AS hit FROM hold_hits_v WHERE rank <= 30 GROUP BY 1, 2) JOIN contexts_v USING (context) GROUP BY 1, 2")
def _(t):
    per = held(t)[0].groupBy("seed", "context").agg(F.max("hit").alias("hit"))
    return per.join(t.categories(), "context").groupBy("seed", "category").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("hit_rate"))


@entry("e7_tier_and_rule_precision", f"SELECT coalesce(tier, 'ALL') AS tier, coalesce(rule, 'ALL') AS rule, coalesce(category, 'ALL') AS category, {HITS} FROM hold_tier_v JOIN contexts_v USING (context) GROUP BY GROUPING SETS ((tier), (rule), (rule, tier), (category, tier))")
def _(t):
    df = held_tiers(t)[0].join(t.categories(), "context")
    g = df.groupingSets([["tier"], ["rule"], ["rule", "tier"], ["category", "tier"]], "tier", "rule", "category").agg(
        F.count("*").alias("n"), F.sum("hit").alias("hits"), F.round(F.avg("hit") * 100, 4).alias("precision_pct"))
    al = lambda c: F.coalesce(c, F.lit("ALL")).alias(c)
    return g.select(al("tier"), al("rule"), al("category"), "n", "hits", "precision_pct")


view("audit_v", """
  SELECT f.tier, f.n AS full_n, f.p AS full_pct, round(h.m, 4) AS holdout_pct, round(h.s, 4) AS holdout_std, round(h.n, 4) AS holdout_n, round(round(h.m, 4) - f.p, 4) AS delta FROM (SELECT tier, count(*) AS n, round(avg(hit) * 100, 4) AS p FROM full_tier_v GROUP BY 1) f
  JOIN (SELECT tier, avg(p) AS m, stddev_pop(p) AS s, avg(n) AS n FROM (SELECT seed, tier, count(*) AS n, avg(hit) * 100 AS p FROM hold_tier_v GROUP BY 1, 2) GROUP BY 1) h USING (tier)""")


@entry("e8_full_vs_holdout_audit", """
  SELECT *, CASE WHEN holdout_n < 10 THEN 'SMALL_N' WHEN delta < -15 THEN 'OVERFITTED' WHEN delta >= -5 THEN 'GENUINE' ELSE 'DEGRADED' END AS status,
    coalesce(lag(holdout_pct) OVER (ORDER BY list_position(['GOLDEN', 'HIGH', 'MEDIUM', 'LOW', 'FILTER'], tier)) >= holdout_pct, true) AS monotone FROM audit_v""")
def _(t):
    return H.audit(full_tiers(t), held_tiers(t)[0])


view("tail_rank_v", """
  SELECT p.context, p.item, count(*) FILTER (-round(list_distance(list_transform(p.cv, lambda x: x - 0.1), i.vec), 6) > p.cut) + 1 AS rank FROM (
    SELECT *, -round(list_distance(list_transform(cv, lambda x: x - 0.1), iv), 6) AS cut FROM truth_vec_v) p, item_vectors_v i GROUP BY 1, 2""")


@entry("e9_link_prediction_ranks", """
  SELECT count(*) AS n, round(avg(rank), 6) AS mean_rank, round(avg(1 / rank), 6) AS mrr, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS hits_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS hits_3, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS hits_10 FROM tail_rank_v""")
def _(t):
    r = F.array(*[F.lit(0.1)] * 64)
    c = t.vectors().select("context", V.minus(V.doubles(F.col("vec")), r).alias("v"))
    i = t.item_vectors().select("item", V.doubles(F.col("vec")).alias("iv"))
    cuts = t.truth().join(c, "context").join(i, "item").select("context", "item", F.round(-V.norm(V.minus(F.col("v"), F.col("iv"))), 6).alias("cut"))
    asked = cuts.groupBy("context").agg(F.collect_set("cut").alias("cuts"))  # one query row per context with its cuts
    q = asked.join(c, "context").select(F.col("context").alias("id"), F.col("v").alias("vec"), "cuts")
    count = count_better_pruned if t.item_vectors().count() > BLOCK_ROWS else count_better  # the rows are the same
    found = count(q, i.select(F.col("item").alias("id"), F.col("iv").alias("vec"))).withColumnRenamed("id", "context")
    rank = cuts.join(found, ["context", "cut"]).withColumn("rank", F.col("better") + 1)
    at = lambda k: F.round(F.avg((F.col("rank") <= k).cast("double")), 6).alias(f"hits_{k}")
    return rank.agg(F.count("*").alias("n"), F.round(F.avg("rank"), 6).alias("mean_rank"), F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"), at(1), at(3), at(10))


@entry("e10_auroc_auprc", """
  WITH s AS (SELECT score, hit, row_number() OVER (ORDER BY score DESC, context, item) AS place, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS ar FROM loo_hits_v),
    p AS (SELECT place, row_number() OVER (ORDER BY place) AS nth FROM s WHERE hit = 1), m AS (SELECT count(*) AS n, sum(hit) AS pos, sum(CASE WHEN hit = 1 THEN ar END) AS r FROM s)
  SELECT n, pos, round((r - pos * (pos + 1) / 2) / (pos * (n - pos)), 6) AS auroc, (SELECT round(avg(nth / place), 6) FROM p) AS auprc, (SELECT round(arg_min(nth / place, nth), 6) FROM p WHERE nth >= pos * 0.5) AS precision_at_50 FROM m""")
def _(t):
    return E.auc(hits(t), "score", "hit", ["context", "item"])


view("prob_v", "SELECT l.context, l.hit, round(score / max(score) OVER (PARTITION BY context), 9) AS p FROM loo_hits_v l")


def probs(t):
    return W.share_of_best(hits(t), ["context"], "score", "p").withColumn("p", F.round("p", 9))


@entry("e11_calibration_bins", "SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(hit), 6) AS rate, round(abs(avg(p) - avg(hit)), 6) AS error FROM prob_v GROUP BY 1")
def _(t):
    return E.calibration_bins(probs(t), "p", "hit")


@entry("e11_calibration_scores", "SELECT (SELECT round(avg(pow(p - hit, 2)), 6) FROM prob_v) AS brier, (SELECT round(avg(e), 6) FROM (SELECT abs(avg(p) - avg(hit)) AS e FROM prob_v GROUP BY least(floor(p * 10), 9))) AS ece")
def _(t):
    return E.calibration_scores(probs(t), "p", "hit")


view("sweep_v", "SELECT threshold, count(*) AS n, sum(hit) AS hits, round(avg(hit) * 100, 4) AS precision_pct FROM (SELECT unnest([3, 4, 5, 6, 7, 8, 9]) AS threshold), prob_v WHERE p * 10 >= threshold GROUP BY 1")


@entry("e12_threshold_choice", "SELECT arg_max(threshold, (n, -threshold)) AS most_rows, arg_max(threshold, (precision_pct, -threshold)) AS best_precision, arg_max(threshold, (round(precision_pct * sqrt(n), 6), -threshold)) AS balanced, count(*) AS n_candidates FROM sweep_v WHERE precision_pct >= 0.5")
def _(t):
    th = F.explode(F.array(*[F.lit(x) for x in range(3, 10)])).alias("threshold")
    sweep = A.precision_by(probs(t).select("hit", "p", th).where(F.col("p") * 10 >= F.col("threshold")), ["threshold"])
    return E.threshold_choice(sweep, 0.5)


@entry("e13_rank_cutoffs", """
  WITH s AS (SELECT category, CASE WHEN rank <= 5 THEN 5 WHEN rank <= 10 THEN 10 WHEN rank <= 15 THEN 15 WHEN rank <= 20 THEN 20 WHEN rank <= 25 THEN 25 ELSE 30 END AS hi, count(*) AS n, round(avg(hit) * 100, 4) AS p FROM full_tier_v JOIN contexts_v USING (context) GROUP BY 1, 2),
    f AS (SELECT category, min(hi) FILTER (n >= 10 AND p < 12) AS ff FROM s GROUP BY 1)
  SELECT s.category, coalesce(max(hi) FILTER (n >= 10 AND p >= 12 AND (ff IS NULL OR hi < ff)), 0) AS cutoff FROM s JOIN f USING (category) GROUP BY 1""")
def _(t):
    top = H.with_hits(top_items(t).select("context", "item", "score", "rank"), t.truth())
    return E.rank_cutoffs(top.join(t.categories(), "context"), "category")


@entry("e14_cost_per_hit", """
  SELECT k, round(100 / precision, 4) AS cost_per_hit, round(100 / b, 4) AS random_cost, round((1 - (100 / precision) / (100 / b)) * 100, 4) AS reduction_pct FROM at_k_v, (SELECT (SELECT count(*) FROM truth_v) / ((SELECT count(DISTINCT context) FROM truth_v) * (SELECT count(*) FROM items_v)) AS b)""")
def _(t):
    truth = t.truth()
    base = truth.agg(F.count("*").alias("p"), F.countDistinct("context").alias("c")).join(F.broadcast(t.items().agg(F.count("*").alias("i"))))
    return E.cost_metrics(at_k(t).join(F.broadcast(base)), F.col("p") / (F.col("c") * F.col("i")), 100.0)


@entry("e15_selection_funnel", """
  SELECT 0 AS step, 'all' AS name, count(*) AS "left" FROM contexts_v UNION ALL SELECT 1, 'with_truth', count(DISTINCT context) FROM truth_v
  UNION ALL SELECT 2, 'with_features', count(DISTINCT context) FROM truth_v JOIN (SELECT DISTINCT context FROM context_features_v) USING (context) UNION ALL SELECT 3, 'with_vector', count(DISTINCT context) FROM truth_v JOIN (SELECT DISTINCT context FROM context_features_v) USING (context) JOIN vectors_v USING (context)""")
def _(t):
    a = t.contexts().select("context")
    b = a.join(t.truth().select("context").distinct(), "context", "left_semi")
    c = b.join(t.context_features(), "context", "left_semi")
    return E.funnel([("all", a), ("with_truth", b), ("with_features", c), ("with_vector", c.join(t.vectors(), "context", "left_semi"))], "context")


@entry("e16_circularity", "SELECT CASE WHEN m = 0 THEN 'none' WHEN m = n THEN 'all' ELSE 'mixed' END AS kind, count(*) AS contexts, sum(n) AS pairs, sum(m) AS in_graph FROM (SELECT t.context, count(*) AS n, count(e.item) AS m FROM truth_v t LEFT JOIN truth_extra_v e USING (context, item) GROUP BY 1) GROUP BY 1")
def _(t):
    return E.circularity(t.truth(), t.truth("A"))


view("loo_votes_v", "SELECT n.context, t.item, round(sum(n.similarity), 6) AS score FROM loo_near_v n JOIN truth_v t ON t.context = n.neighbour GROUP BY 1, 2")
view("strata_v", """
  SELECT t.context, any_value(c.category) AS category, CASE WHEN count(*) <= 5 THEN '1-5' WHEN count(*) <= 12 THEN '6-12' ELSE '13+' END AS size_band, CASE WHEN any_value(s.max_similarity) >= 0.35 THEN 'near' ELSE 'far' END AS reach, count(*) AS size, count(v.item) AS in_pool, count(l.item) AS found
  FROM truth_v t JOIN contexts_v c USING (context) JOIN neighbour_stats_v s USING (context) LEFT JOIN loo_votes_v v ON v.context = t.context AND v.item = t.item LEFT JOIN loo_top_v l ON l.context = t.context AND l.item = t.item GROUP BY 1""")


@entry("e17_stratified_recall", """
  SELECT size_band, reach, category, in_pool > 0 AS covered, count(*) AS n, round(sum(found) / sum(size), 6) AS micro, round(avg(found / size), 6) AS macro FROM strata_v GROUP BY 1, 2, 3, 4""")
def _(t):
    n = cut_lineage(near(t, exclude_self=True))
    pool = cut_lineage(S.vote(n, t.truth()))
    top = W.top_n(pool, ["context"], "score", "item", 30)
    best = n.groupBy("context").agg(F.max("similarity").alias("mx"))
    ids = ["context", "item"]
    per = t.truth().join(best, "context").join(pool.select(*ids, F.lit(1).alias("p")), ids, "left").join(top.select(*ids, F.lit(1).alias("f")), ids, "left").groupBy("context").agg(
        F.count("*").alias("size"), F.count("p").alias("in_pool"), F.count("f").alias("found"), F.max("mx").alias("mx"))
    band = F.when(F.col("size") <= 5, "1-5").when(F.col("size") <= 12, "6-12").otherwise("13+")
    return per.join(t.categories(), "context").groupBy(band.alias("size_band"), F.when(F.col("mx") >= 0.35, "near").otherwise("far").alias("reach"), "category", (F.col("in_pool") > 0).alias("covered")).agg(
        F.count("*").alias("n"), F.round(F.sum("found") / F.sum("size"), 6).alias("micro"), F.round(F.avg(F.col("found") / F.col("size")), 6).alias("macro"))


@entry("e18_blocked_pairs", """
  SELECT t.context, t.item, (SELECT count(*) FROM loo_near_v n JOIN truth_v k ON k.context = n.neighbour WHERE n.context = t.context AND k.item = t.item) AS holders FROM truth_v t
  WHERE t.context IN (SELECT context FROM vectors_v) AND NOT EXISTS (SELECT 1 FROM loo_top_v l WHERE l.context = t.context AND l.item = t.item)""")
def _(t):
    n = cut_lineage(near(t, exclude_self=True))
    return E.blocked_pairs(t.truth(), W.top_n(S.vote(n, t.truth()), ["context"], "score", "item", 30), n)


@entry("e19_zero_truth_benchmark", """
  SELECT name, max(CASE WHEN ok THEN 1 ELSE 0 END) AS in_graph FROM (SELECT c.name, EXISTS (SELECT 1 FROM (SELECT DISTINCT name FROM contexts_v WHERE balance > 5000) g WHERE contains(g.name, c.name) OR contains(c.name, g.name)) AS ok
    FROM contexts_v c GROUP BY c.name HAVING max(CASE WHEN c.balance > 9000 THEN 1 ELSE 0 END) = 0) GROUP BY 1""")
def _(t):
    c = t.contexts()
    none = c.groupBy("name").agg(F.max((F.col("balance") > 9000).cast("int")).alias("approved")).where("approved = 0").select("name")
    graph = c.where("balance > 5000").select(F.col("name").alias("g")).distinct()
    found = N.either_contains(none, "name", graph, "g", 5, short=True).select("name").distinct().withColumn("y", F.lit(1))
    return none.join(found, "name", "left").select("name", F.coalesce("y", F.lit(0)).alias("in_graph"))


@entry("e20_parameter_sweep", """
  SELECT k, n, hits, recall, k = first(k) OVER (ORDER BY recall DESC, k) AS best FROM (
    SELECT k, count(*) AS n, sum(CASE WHEN t.item IS NULL THEN 0 ELSE 1 END) AS hits, round(sum(CASE WHEN t.item IS NULL THEN 0 ELSE 1 END) / (SELECT count(*) FROM truth_v WHERE context IN (SELECT context FROM vectors_v)), 6) AS recall FROM (
      SELECT k, context, item, row_number() OVER (PARTITION BY k, context ORDER BY score DESC, item) AS rank FROM (
        SELECT k, n.context, t.item, round(sum(similarity), 6) AS score FROM loo_near_v n, (SELECT unnest([5, 10, 15, 20]) AS k), truth_v t WHERE place <= k AND t.context = n.neighbour GROUP BY 1, 2, 3)) r LEFT JOIN truth_v t USING (context, item) WHERE rank <= 30 GROUP BY 1)""")
def _(t):
    n = near(t, exclude_self=True).withColumn("k", F.explode(F.array(*[F.lit(k) for k in (5, 10, 15, 20)]))).where("place <= k")
    v = n.join(t.truth().select(F.col("context").alias("neighbour"), "item"), "neighbour").groupBy("k", "context", "item").agg(F.round(F.sum("similarity"), 6).alias("score"))
    h = H.with_hits(W.top_n(v, ["k", "context"], "score", "item", 30), t.truth())
    total = t.truth().join(t.vectors(), "context", "left_semi").agg(F.count("*").alias("total"))
    out = cut_lineage(h.groupBy("k").agg(F.count("*").alias("n"), F.sum("hit").alias("hits")).join(F.broadcast(total)).select("k", "n", "hits", F.round(F.col("hits") / F.col("total"), 6).alias("recall")))
    best = out.agg(F.max_by("k", F.struct("recall", (-F.col("k")).alias("t"))).alias("b"))
    return out.join(F.broadcast(best)).select("k", "n", "hits", "recall", (F.col("k") == F.col("b")).alias("best"))


@entry("e21_what_if_simulation", f"""
  SELECT old_tier, new_tier, {HITS} FROM (SELECT hit, tier AS old_tier, CASE WHEN tier = 'MEDIUM' AND category = 'building' THEN 'LOW' WHEN tier = 'LOW' AND mech AND rank <= 5 THEN 'MEDIUM' ELSE tier END AS new_tier FROM hold_tier_v JOIN contexts_v USING (context)) GROUP BY 1, 2""")
def _(t):
    df = cut_lineage(held_tiers(t)[0].join(t.categories(), "context"))
    new = F.when((F.col("tier") == "MEDIUM") & (F.col("category") == "building"), "LOW").when((F.col("tier") == "LOW") & F.col("mechanism") & (F.col("rank") <= 5), "MEDIUM").otherwise(F.col("tier"))
    return E.moved_rows(df, df.withColumn("tier", new), ["seed", "context", "item"])


@entry("e22_known_vs_novel", f"SELECT tier, x.item IS NOT NULL AS known, {HITS} FROM hold_tier_v h LEFT JOIN truth_extra_v x USING (context, item) GROUP BY 1, 2")
def _(t):
    x = t.truth("A").withColumn("known", F.lit(True))
    return A.precision_by(held_tiers(t)[0].join(x, ["context", "item"], "left").withColumn("known", F.coalesce("known", F.lit(False))), ["tier", "known"])


@entry("e23_subgroup_holdout", """
  SELECT class1, count(*) AS n_seeds, round(avg(n), 4) AS mean_n, round(avg(p), 4) AS mean, round(stddev_pop(p), 4) AS std FROM (SELECT seed, class1, count(*) AS n, avg(hit) * 100 AS p FROM hold_tier_v JOIN items_v USING (item) WHERE tier IN ('HIGH', 'MEDIUM') GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 3 AND round(avg(n), 4) >= 2""")
def _(t):
    return E.subgroup(held_tiers(t)[0].join(t.items().select("item", "class1"), "item"), F.col("tier").isin("HIGH", "MEDIUM"), ["class1"])


@entry("e24_artifact_exclusion", f"SELECT tier, 'all' AS scope, {HITS} FROM hold_tier_v GROUP BY 1 UNION ALL SELECT tier, 'without', {HITS} FROM hold_tier_v JOIN items_v USING (item) WHERE NOT contains(name, 'plate') GROUP BY 1")
def _(t):
    df = cut_lineage(held_tiers(t)[0].join(t.items().select("item", "name"), "item"))
    part = lambda d, n: A.precision_by(d, ["tier"]).withColumn("scope", F.lit(n))
    return part(df, "all").unionByName(part(df.where(~F.contains("name", F.lit("plate"))), "without"))


view("mech_hits_v", "SELECT m.context, m.item, CASE WHEN t.item IS NULL THEN 0 ELSE 1 END AS hit FROM mech_v m LEFT JOIN truth_v t USING (context, item)")


def mech_hits(t):
    return H.with_hits(mechanism_of_vectors(t), t.truth())


@entry("e25_model_comparison", """
  SELECT count(*) AS n, count(*) FILTER (a.h > b.h) AS better, count(*) FILTER (a.h < b.h) AS worse, count(*) FILTER (a.h = b.h) AS same, sum(a.h) AS hits_first, sum(b.h) AS hits_second
  FROM (SELECT context, sum(hit) AS h FROM loo_hits_v GROUP BY 1) a JOIN (SELECT context, sum(hit) AS h FROM mech_hits_v GROUP BY 1) b USING (context)""")
def _(t):
    return E.compare_models(hits(t), mech_hits(t))


@entry("e26_recall_after_growth", """
  SELECT context, count(t.item) AS old_truth, count(*) AS new_truth, round(CASE WHEN count(t.item) > 0 THEN count(l.item) FILTER (t.item IS NOT NULL) / count(t.item) ELSE 0 END, 6) AS old_recall, round(count(l.item) / count(*), 6) AS new_recall
  FROM (SELECT context, item FROM truth_v UNION SELECT context, item FROM truth_extra_v) a LEFT JOIN truth_v t USING (context, item) LEFT JOIN loo_top_v l USING (context, item) WHERE context IN (SELECT context FROM vectors_v) GROUP BY 1""")
def _(t):
    ids = ["context", "item"]
    grown = t.truth().union(t.truth("A")).distinct().join(t.vectors(), "context", "left_semi")
    df = grown.join(t.truth().withColumn("o", F.lit(1)), ids, "left").join(loo_top(t).select(*ids, F.lit(1).alias("f")), ids, "left")
    old = F.count("o")
    return df.groupBy("context").agg(old.alias("old_truth"), F.count("*").alias("new_truth"), F.round(F.when(old > 0, F.count(F.when(F.col("o") == 1, F.col("f"))) / old).otherwise(0.0), 6).alias("old_recall"), F.round(F.count("f") / F.count("*"), 6).alias("new_recall"))


@entry("e27_item_hit_rate", "SELECT t.item, count(*) AS opportunities, count(l.item) AS hits, round(count(l.item) / count(*), 6) AS hit_rate FROM truth_v t LEFT JOIN loo_top_v l USING (context, item) WHERE t.context IN (SELECT context FROM vectors_v) GROUP BY 1")
def _(t):
    df = t.truth().join(t.vectors(), "context", "left_semi").join(loo_top(t).select("context", "item", F.lit(1).alias("f")), ["context", "item"], "left")
    return df.groupBy("item").agg(F.count("*").alias("opportunities"), F.count("f").alias("hits"), F.round(F.count("f") / F.count("*"), 6).alias("hit_rate"))


@entry("e28_precision_lift", """
  SELECT category, round(avg(hit) FILTER (mech) * 100, 4) AS with_flag, round(avg(hit) FILTER (NOT mech) * 100, 4) AS without_flag, round((avg(hit) FILTER (mech) - avg(hit) FILTER (NOT mech)) * 100, 4) AS lift FROM hold_tier_v JOIN contexts_v USING (context) GROUP BY 1""")
def _(t):
    m = F.col("mechanism")
    a, b = F.avg(F.when(m, F.col("hit"))), F.avg(F.when(~m, F.col("hit")))
    return held_tiers(t)[0].join(t.categories(), "context").groupBy("category").agg(F.round(a * 100, 4).alias("with_flag"), F.round(b * 100, 4).alias("without_flag"), F.round((a - b) * 100, 4).alias("lift"))


@entry("e29_reachable_truth", "SELECT category, count(*) AS pairs, count(o.item) AS reachable, round(count(o.item) / count(*), 6) AS share FROM truth_v t JOIN contexts_v c USING (context) LEFT JOIN overlap_v o ON o.context = t.context AND o.item = t.item GROUP BY 1")
def _(t):
    o = pair_overlap(t.truth(), t.item_features(), t.context_features()).join(t.categories(), "context")
    r = F.count_if(F.col("overlap") > 0)
    return o.groupBy("category").agg(F.count("*").alias("pairs"), r.alias("reachable"), F.round(r / F.count("*"), 6).alias("share"))


@entry("e30_precision_in_top_share", f"SELECT share, {HITS} FROM (SELECT hit, row_number() OVER (ORDER BY score DESC, context, item) AS place, count(*) OVER () AS c FROM loo_hits_v), (SELECT unnest([0.05, 0.1, 0.2]::DOUBLE[]) AS share) WHERE place <= ceil(share * c) GROUP BY 1")
def _(t):
    return E.top_share_precision(hits(t).select("context", "item", "score", "hit"), "score", ["context", "item"], [0.05, 0.1, 0.2])


@entry("e31_benchmark_by_name", """
  SELECT v.context, max(CASE WHEN k.name IS NULL THEN 0 ELSE 1 END) AS hit, count(DISTINCT k.name) AS names_hit FROM top_v v JOIN items_v i USING (item)
  LEFT JOIN (SELECT DISTINCT context, name FROM truth_extra_v JOIN items_v USING (item)) k ON k.context = v.context AND contains(i.name, k.name) GROUP BY 1""")
def _(t):
    i = t.items().select("item", "name")
    listed = t.truth("A").join(i, "item").select("context", F.col("name").alias("listed")).distinct()
    same = N.contains_join(i, "name", listed.select("listed"), "listed", 4, short=True)
    hit = top_items(t).join(i, "item").join(same, "name").join(listed, ["context", "listed"], "left_semi").groupBy("context").agg(F.countDistinct("listed").alias("names_hit"))
    all_contexts = top_items(t).select("context").distinct()
    return all_contexts.join(hit, "context", "left").select("context", F.when(F.col("names_hit") > 0, 1).otherwise(0).alias("hit"), F.coalesce("names_hit", F.lit(0)).alias("names_hit"))


@entry("e32_random_edge_split", "SELECT *, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'valid' ELSE 'test' END AS part FROM (SELECT * EXCLUDE (h), h / 4294967296 AS u FROM (SELECT context, item, ('0x' || substr(md5('42:' || context || ':' || item), 1, 8))::BIGINT AS h FROM truth_v))".replace("SELECT *, CASE", "SELECT context, item, CASE"))
def _(t):
    return E.edge_split(t.truth().select("context", "item"))


@entry("e33_traversal_holdout", """
  SELECT s.seed, count(*) AS n_contexts, round(sum(found) / sum(size), 6) AS micro, round(avg(found / size), 6) AS macro FROM split_v s JOIN (SELECT context, count(*) AS size FROM truth_v GROUP BY 1) z USING (context)
  LEFT JOIN (SELECT context, sum(hit) AS f FROM mech_hits_v GROUP BY 1) m USING (context), LATERAL (SELECT coalesce(m.f, 0) AS found) WHERE s.test GROUP BY 1""")
def _(t):
    parts = cut_lineage(H.split(t.vectors().join(t.truth().select("context").distinct(), "context", "left_semi")).where("test"))
    return E.recall(mech_hits(t).join(parts.select("seed", "context"), "context"), t.truth(), parts, ["seed"])


# ---- statistics ------------------------------------------------------------------------
def measured(t):
    return t.items().select("item", F.col("size").cast("double").alias("size"), "price").join(A.frequency(t.truth()).withColumn("freq", F.col("train_frequency").cast("double")), "item")


view("measured_v", "SELECT i.item, size, price, train_frequency AS freq FROM items_v i JOIN frequency_v USING (item)")
RK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2"


@entry("t1_correlations", f"""
  WITH r AS (SELECT *, {RK.format('size')} AS rs, {RK.format('price')} AS rp, {RK.format('freq')} AS rf FROM measured_v),
    c AS (SELECT corr(size, price) AS p0, corr(size, freq) AS p1, corr(price, freq) AS p2, corr(rs, rp) AS s0, corr(rs, rf) AS s1, corr(rp, rf) AS s2 FROM r)
  SELECT unnest(['size', 'size', 'price']) AS a, unnest(['price', 'freq', 'freq']) AS b, unnest([round(p0, 6), round(p1, 6), round(p2, 6)]) AS pearson, unnest([round(s0, 6), round(s1, 6), round(s2, 6)]) AS spearman, unnest([abs(p0) < 0.3, abs(p1) < 0.3, abs(p2) < 0.3]) AS weak FROM c""")
def _(t):
    return E.correlations(measured(t), ["size", "price", "freq"])


@entry("t2_partial_correlation", "SELECT round(xy, 6) AS plain, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM (SELECT corr(size, freq) AS xy, corr(size, price) AS xz, corr(freq, price) AS yz FROM measured_v)")
def _(t):
    return E.partial_correlation(measured(t), "size", "freq", "price")


view("both_hits_v", "SELECT context, a.h AS h1, b.h AS h2 FROM (SELECT context, sum(hit) AS h FROM loo_hits_v GROUP BY 1) a JOIN (SELECT context, sum(hit) AS h FROM mech_hits_v GROUP BY 1) b USING (context)")


def both_hits(t):
    s = lambda d, n: d.groupBy("context").agg(F.sum("hit").alias(n))
    return s(hits(t), "h1").join(s(mech_hits(t), "h2"), "context")


@entry("t3_paired_t", "SELECT count(*) AS n, round(avg(h1 - h2), 6) AS mean_difference, round(avg(h1 - h2) / (stddev_samp(h1 - h2) / sqrt(count(*))), 6) AS t FROM both_hits_v")
def _(t):
    return E.paired_t(both_hits(t), "h1", "h2")


view("grouped_v", "SELECT item, freq, CASE WHEN size > 25 THEN 1 ELSE 0 END AS big FROM measured_v")


def grouped(t):
    return measured(t).select("item", "freq", (F.col("size") > 25).cast("int").alias("big"))


MANN_WHITNEY = f"SELECT n1, n - n1 AS n2, round(u, 4) AS u, round((u - n1 * (n - n1) / 2) / sqrt(n1 * (n - n1) * (n + 1) / 12), 6) AS z FROM (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM (SELECT sum(big) AS n1, count(*) AS n, sum(r) FILTER (big = 1) AS r1 FROM (SELECT big, {RK.format('freq')} AS r FROM grouped_v)))"


@entry("t3_mann_whitney", MANN_WHITNEY)
def _(t):
    return E.mann_whitney(grouped(t), "freq", "big")


WILCOXON = f"SELECT n, round(w, 4) AS w_plus, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24), 6) AS z FROM (SELECT count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w FROM (SELECT d, {RK.format('m')} AS r FROM (SELECT h1 - h2 AS d, abs(h1 - h2) AS m FROM both_hits_v WHERE h1 <> h2)))"


@entry("t3_wilcoxon", WILCOXON)
def _(t):
    return E.wilcoxon(both_hits(t), "h1", "h2")


# the series of erf with each term by logarithms: 2^n x^(2n+1) / (2n+1)!!, (2n+1)!! = (2n+1)! / (2^n n!)
ERF_TERM = "exp(2 * n * ln(2) + (2 * n + 1) * ln(x) + lgamma(n + 1) - lgamma(2 * n + 2))"


@entry("t3_p_values", f"""
  SELECT test, z, round(1 - CASE WHEN x = 0 THEN 0 ELSE 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(161)::DOUBLE[], lambda n: {ERF_TERM})) END, 9) AS p
  FROM (SELECT *, least(abs(z) / sqrt(2), 6) AS x FROM (SELECT 'mann_whitney' AS test, z FROM ({MANN_WHITNEY}) UNION ALL SELECT 'wilcoxon', z FROM ({WILCOXON})))""")
def _(t):
    z = E.mann_whitney(grouped(t), "freq", "big").select(F.lit("mann_whitney").alias("test"), "z").union(E.wilcoxon(both_hits(t), "h1", "h2").select(F.lit("wilcoxon"), "z"))
    return E.with_normal_p(z)


def mcnemar(t):
    flag = lambda d, n: d.groupBy("context").agg(F.max("hit").alias("hit"))
    return E.mcnemar(flag(hits(t), "a"), flag(mech_hits(t), "b"), "context")


MCNEMAR = "SELECT count(*) FILTER (h1 > 0 AND h2 > 0) AS both, count(*) FILTER (h1 > 0 AND h2 = 0) AS first_only, count(*) FILTER (h1 = 0 AND h2 > 0) AS second_only, count(*) FILTER (h1 = 0 AND h2 = 0) AS neither FROM both_hits_v"


@entry("t4_mcnemar_counts", MCNEMAR)
def _(t):
    return mcnemar(t)


@entry("t4_sign_test_p", f"""
  SELECT *, round(least(1, list_sum(list_transform(range(first_only, n + 1)::DOUBLE[], lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))), 9) AS p
  FROM (SELECT *, first_only + second_only AS n FROM ({MCNEMAR}))""".replace("SELECT *, round", "SELECT * EXCLUDE (n), round"))
def _(t):
    return E.with_sign_p(mcnemar(t))


@entry("t5_bootstrap_interval", """
  WITH p AS (SELECT h1, row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || context), 1, 8))::BIGINT, context) AS position, count(*) OVER () AS n FROM both_hits_v),
    d AS (SELECT rep, ('0x' || substr(md5('42:' || rep || ':' || position), 1, 8))::BIGINT % n + 1 AS pick FROM p, (SELECT unnest(range(1, 1001)) AS rep)),
    m AS (SELECT rep, avg(h1) AS m FROM d JOIN p ON p.position = d.pick GROUP BY 1)
  SELECT count(*) AS reps, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def _(t):
    return E.bootstrap_mean(both_hits(t), "context", "h1", reps=1000)


@entry("t6_effect_size", """
  SELECT n1, n0, round(d, 6) AS d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM (
    SELECT n1, n0, (m1 - m0) / sqrt(((n1 - 1) * s1 + (n0 - 1) * s0) / (n1 + n0 - 2)) AS d FROM (SELECT count(*) FILTER (big = 1) AS n1, count(*) FILTER (big = 0) AS n0, avg(freq) FILTER (big = 1) AS m1, avg(freq) FILTER (big = 0) AS m0,
      var_samp(freq) FILTER (big = 1) AS s1, var_samp(freq) FILTER (big = 0) AS s0 FROM grouped_v))""")
def _(t):
    return E.cohens_d(grouped(t), "freq", "big")


@entry("t7_z_against_baseline", """
  SELECT tier, n_seeds, mean, std, CASE WHEN std > 0 THEN round((mean - 1.0) / (std / sqrt(n_seeds)), 4) END AS z FROM (
    SELECT tier, count(*) AS n_seeds, round(avg(p), 4) AS mean, round(stddev_pop(p), 4) AS std FROM (SELECT seed, tier, avg(hit) * 100 AS p FROM hold_tier_v GROUP BY 1, 2) GROUP BY 1)""")
def _(t):
    per = held_tiers(t)[0].groupBy("seed", "tier").agg((F.avg("hit") * 100).alias("p"))
    return E.z_against(H.over_seeds(per, ["tier"], "p"), "mean", "std", "n_seeds", 1.0)
