"""A, W and U entries: aggregates, windows and set operations."""

from pyspark.sql import functions as F

from loomgraph.catalog.base import entry, view
from loomgraph.catalog.similarity import loo_top, near, near_with_and_without, top_items, votes
from loomgraph.catalog.tiering import tiered
from loomgraph.operators import aggregate as A
from loomgraph.operators import ranking as W
from loomgraph.operators import rules as P
from loomgraph.operators import similar as S
from loomgraph.plans import predict as PR
from loomgraph.session import cut_lineage

HITS = "count(*) AS n, sum(hit) AS hits, round(avg(hit) * 100, 4) AS precision_pct"
view("loo_hits_v", "SELECT l.context, l.item, l.score, l.rank, CASE WHEN t.item IS NULL THEN 0 ELSE 1 END AS hit FROM loo_top_v l LEFT JOIN truth_v t ON t.context = l.context AND t.item = l.item")


def hits(t):
    known = t.truth().withColumn("hit", F.lit(1))
    return cut_lineage(loo_top(t)).join(known, ["context", "item"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def classes(t, level="class1"):
    return t.items().select("item", F.col(level).alias("cls"))


@entry("a1_training_frequency", "SELECT * FROM frequency_v")
def _(t):
    return A.frequency(t.truth())


view("neighbour_stats_v", """
  SELECT n.context, round(avg(similarity), 9) AS mean_similarity, max(similarity) AS max_similarity, min(similarity) AS min_similarity, round(stddev_pop(similarity), 6) AS std_similarity,
    count(s.n) AS n_with_items, round(avg(s.n), 6) AS mean_items, max(s.n) AS max_items FROM loo_near_v n LEFT JOIN (SELECT context, count(*) AS n FROM truth_v GROUP BY 1) s ON s.context = n.neighbour GROUP BY 1""")


@entry("a2_neighbour_statistics", "SELECT s.*, p.n AS pool_size FROM neighbour_stats_v s JOIN (SELECT n.context, count(DISTINCT item) AS n FROM loo_near_v n JOIN truth_v t ON t.context = n.neighbour GROUP BY 1) p USING (context)")
def _(t):
    n = cut_lineage(near(t, exclude_self=True))
    return A.neighbour_statistics(n, t.truth(), S.vote(n, t.truth()))


view("thirds_v", "SELECT context, mean_similarity, ntile(3) OVER (ORDER BY mean_similarity, context) AS part FROM neighbour_stats_v")


@entry("a3_coverage_strength", f"SELECT part, {HITS} FROM loo_hits_v JOIN thirds_v USING (context) GROUP BY 1")
def _(t):
    stats = near(t, exclude_self=True).groupBy("context").agg(F.round(F.avg("similarity"), 9).alias("mean_similarity"))
    parts = W.quantile_groups(stats, [F.col("mean_similarity"), F.col("context")], 3)
    return A.precision_by(hits(t).join(parts.select("context", "part"), "context"), ["part"])


@entry("a4_score_distribution", """
  WITH r AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY score DESC, item) AS rank FROM vote_v),
    m AS (SELECT context, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 20) AS s20, max(score) FILTER (rank = 21) AS s21, max(score) FILTER (rank = 30) AS s30, sum(score) FILTER (rank <= 30) AS total,
      count(DISTINCT score) AS n_distinct, avg(score) FILTER (rank <= 30) AS mean30, stddev_pop(score) FILTER (rank <= 30) AS std30 FROM r GROUP BY 1)
  SELECT m.context, round(any_value(s20) - any_value(s21), 6) AS margin_20, round(any_value(s20) / any_value(s1), 6) AS ratio_20, round(any_value(s30) / any_value(s1), 6) AS ratio_30,
    round(sum(-(score / total) * ln(score / total + 1e-10)) FILTER (rank <= 30), 4) AS entropy, count(*) FILTER (score = s20) AS ties_at_20, any_value(n_distinct) AS n_distinct, round(any_value(std30) / any_value(mean30), 6) AS dispersion
  FROM m JOIN r USING (context) GROUP BY 1""")
def _(t):
    return A.score_distribution(cut_lineage(W.ranked(votes(t), ["context"], "score", "item")))


STAB = "count(*) AS n, round(avg(rank), 6) AS mean_rank, round(stddev_pop(rank), 6) AS std_rank, round(stddev_pop(rank) / avg(rank), 6) AS cv, min(rank) AS min_rank, max(rank) AS max_rank, max(rank) - min(rank) AS spread, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS share_top5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS share_top10"


@entry("a5_item_rank_stability", f"SELECT item, {STAB} FROM top_v GROUP BY 1")
def _(t):
    return A.rank_stability(top_items(t), ["item"])


view("draw_top_v", """
  SELECT draw, context, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY draw, context ORDER BY score DESC, item) AS rank FROM (
    SELECT n.draw, n.context, t.item, round(sum(similarity), 9) AS score FROM (
      SELECT d.draw, p.context, p.neighbour, p.similarity, row_number() OVER (PARTITION BY d.draw, p.context ORDER BY p.similarity DESC, p.neighbour) AS place
      FROM pairs_v p JOIN draws_v d ON d.context = p.neighbour WHERE p.context <> p.neighbour AND d.draw <= 5) n JOIN truth_v t ON t.context = n.neighbour WHERE n.place <= 20 GROUP BY 1, 2, 3)) WHERE rank <= 30""")


def draw_top(t):
    v = S.draw_votes(t.vectors(), t.truth(), 5, exclude_self=True, digits=9)
    return W.top_n(v, ["draw", "context"], "score", "item", 30)


@entry("a6_rank_stability_across_seeds", f"SELECT context, item, {STAB} FROM draw_top_v GROUP BY 1, 2 HAVING count(*) >= 3 AND min(rank) <= 30")
def _(t):
    return A.rank_stability(draw_top(t), ["context", "item"]).where((F.col("n") >= 3) & (F.col("min_rank") <= 30))


@entry("a7_class_width", "SELECT class2 AS cls, count(*) AS n_items, round(avg(train_frequency), 6) AS width FROM items_v JOIN frequency_v USING (item) GROUP BY 1")
def _(t):
    return A.class_width(t.truth(), classes(t, "class2"))


@entry("a7_isolation_precision", f"SELECT cls, isolated, {HITS} FROM (SELECT class2 AS cls, hit, count(*) OVER (PARTITION BY context, class2) = 1 AS isolated FROM loo_hits_v JOIN items_v USING (item)) GROUP BY 1, 2")
def _(t):
    return A.isolation_precision(hits(t), classes(t, "class2"))


@entry("a8_class_uniqueness", """
  WITH p AS (SELECT v.context, i.class1, i.class2, v.item FROM vote_v v JOIN items_v i USING (item))
  SELECT v.context, v.item, (SELECT n FROM (SELECT context, class1, count(*) AS n FROM p GROUP BY 1, 2) a WHERE a.context = v.context AND a.class1 = i.class1) - 1 AS mates1,
    (SELECT n FROM (SELECT context, class2, count(*) AS n FROM p GROUP BY 1, 2) b WHERE b.context = v.context AND b.class2 = i.class2) - 1 AS mates2, br.n AS breadth, coalesce(s.n, 0) AS support
  FROM top_v v JOIN items_v i USING (item) JOIN (SELECT class2, count(*) AS n FROM items_v GROUP BY 1) br ON br.class2 = i.class2
  LEFT JOIN (SELECT n.context, t.item, count(*) AS n FROM near_v n JOIN truth_v t ON t.context = n.neighbour GROUP BY 1, 2) s ON s.context = v.context AND s.item = v.item""")
def _(t):
    n = cut_lineage(near(t))
    v = cut_lineage(S.vote(n, t.truth()))
    return A.class_uniqueness(W.top_n(v, ["context"], "score", "item", 30), v, n, t.truth(), t.items().select("item", "class1", "class2"))


@entry("a9_group_summary", "SELECT item, count(*) AS n, round(avg(score), 9) AS mean_score, min(context) AS first_context, count(DISTINCT category) AS n_categories FROM top_v JOIN contexts_v USING (context) GROUP BY 1")
def _(t):
    return top_items(t).join(t.categories(), "context").groupBy("item").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("mean_score"), F.min("context").alias("first_context"), F.countDistinct("category").alias("n_categories"))


@entry("a10_crosstab", "SELECT coalesce(class1, 'ALL') AS class1, coalesce(category, 'ALL') AS category, count(*) AS n, sum(hit) AS hits, round(sum(hit) * 100 / count(*), 4) AS precision_pct FROM loo_hits_v JOIN items_v USING (item) JOIN contexts_v USING (context) GROUP BY CUBE (class1, category)")
def _(t):
    return A.crosstab(hits(t).join(t.items().select("item", "class1"), "item").join(t.categories(), "context"), "class1", "category")


@entry("a11_context_statistics", """
  SELECT context, count(*) AS n_draws, round(avg(hit), 6) AS mean_hit, round(avg(p), 6) AS mean_p, round(abs(avg(hit) - avg(p)), 6) AS error FROM (
    SELECT d.draw, d.context, max(CASE WHEN t.item IS NULL THEN 0 ELSE 1 END) AS hit, least(max(d.score), 1) AS p FROM draw_top_v d LEFT JOIN truth_v t ON t.context = d.context AND t.item = d.item GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    known = t.truth().withColumn("hit", F.lit(1))
    per = draw_top(t).join(known, ["context", "item"], "left").groupBy("draw", "context").agg(
        F.coalesce(F.max("hit"), F.lit(0)).alias("hit"), F.least(F.max("score"), F.lit(1.0)).alias("p"))
    return per.groupBy("context").agg(F.count("*").alias("n_draws"), F.round(F.avg("hit"), 6).alias("mean_hit"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.abs(F.avg("hit") - F.avg("p")), 6).alias("error"))


@entry("a12_truth_completeness", """
  SELECT a.context, count(t.item) AS known, count(*) AS expanded, round(count(t.item) / count(*), 6) AS completeness FROM (SELECT context, item FROM truth_v UNION SELECT context, item FROM truth_extra_v) a LEFT JOIN truth_v t USING (context, item) GROUP BY 1""")
def _(t):
    return PR.truth_completeness(t.truth(), t.truth().unionByName(t.truth("A")).distinct())


@entry("a12_self_reference", "SELECT context, count(*) AS n_items, round(avg(CASE WHEN train_frequency = 1 THEN 1.0 ELSE 0 END) * 100, 4) AS self_only_pct, count(*) > 5 AND min(CASE WHEN train_frequency = 1 THEN 1 ELSE 0 END) = 1 AS island FROM truth_v JOIN frequency_v USING (item) GROUP BY 1")
def _(t):
    return A.self_reference(t.truth())


@entry("a13_error_profile", """
  WITH r AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY score DESC, item) AS rank FROM (SELECT n.context, t.item, round(sum(n.similarity), 6) AS score FROM loo_near_v n JOIN truth_v t ON t.context = n.neighbour GROUP BY 1, 2))
  SELECT i.class1 AS kind, c.category, CASE WHEN rank IS NULL THEN 'none' WHEN rank <= 50 THEN '31-50' WHEN rank <= 100 THEN '51-100' ELSE '101+' END AS band, count(*) AS missed
  FROM truth_v t LEFT JOIN r USING (context, item) JOIN items_v i USING (item) JOIN contexts_v c USING (context) WHERE rank IS NULL OR rank > 30 GROUP BY 1, 2, 3""")
def _(t):
    r = W.ranked(votes(t, exclude_self=True), ["context"], "score", "item")
    return A.error_profile(t.truth(), r, t.items().select("item", F.col("class1").alias("kind")), t.categories())


@entry("a14_category_rollup", "SELECT CASE WHEN regexp_matches(name, '(furniture|household)') THEN 'home' WHEN regexp_matches(name, '(machinery|automobile)') THEN 'engine' ELSE 'other' END AS kind, count(*) AS n, count(DISTINCT name) AS n_names, min(name) AS first, max(name) AS last FROM contexts_v GROUP BY 1")
def _(t):
    k = P.keyword_category(F.col("name"), {"home": ["furniture", "household"], "engine": ["machinery", "automobile"]})
    return t.contexts().groupBy(k.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("name").alias("n_names"), F.min("name").alias("first"), F.max("name").alias("last"))


@entry("a15_feature_coverage", """
  SELECT count(*) AS items, count(*) FILTER (item IN (SELECT item FROM item_features_v)) AS with_features, count(*) FILTER (item IN (SELECT item FROM item_groups_v)) AS with_groups, count(*) FILTER (item IN (SELECT item FROM item_vectors_v)) AS with_vector FROM items_v""")
def _(t):
    f = t.item_features().groupBy("item").agg(F.count("*").alias("n_f"))
    g = t.item_features().join(t.feature_groups(), "feature").groupBy("item").agg(F.count("*").alias("n_g"))
    v = t.item_vectors().select("item", F.lit(1).alias("n_v"))
    return t.items().select("item").join(f, "item", "left").join(g, "item", "left").join(v, "item", "left").agg(
        F.count("*").alias("items"), F.count_if(F.col("n_f") > 0).alias("with_features"), F.count_if(F.col("n_g") > 0).alias("with_groups"), F.count_if(F.col("n_v") > 0).alias("with_vector"))


@entry("a16_coherence_patterns", f"SELECT code, category, coherent, {HITS} FROM (SELECT i.class1 AS code, c.category, (c.category, i.class1) IN (SELECT (category, code) FROM coherent_v) AS coherent, hit FROM loo_hits_v JOIN items_v i USING (item) JOIN contexts_v c USING (context)) GROUP BY 1, 2, 3")
def _(t):
    from loomgraph.catalog.words import words

    df = PR.named(hits(t), t.contexts(), t.items())
    return A.precision_by(df.withColumn("coherent", P.class_coherent(F.array("code"), F.col("category"), words().coherent)), ["code", "category", "coherent"])


@entry("a17_group_profile", """
  WITH d AS (SELECT s.context, s.mean_similarity, s.max_items, f.n AS n_features, h.hit FROM neighbour_stats_v s LEFT JOIN (SELECT context, count(*) AS n FROM context_features_v GROUP BY 1) f USING (context)
    JOIN (SELECT context, max(hit) AS hit FROM loo_hits_v GROUP BY 1) h USING (context))
  SELECT measure, round(y, 6) AS mean_yes, round(n, 6) AS mean_no, round(y - n, 6) AS difference FROM (
    SELECT unnest(['mean_similarity', 'max_items', 'n_features']) AS measure, unnest([avg(mean_similarity) FILTER (hit = 1), avg(max_items) FILTER (hit = 1), avg(n_features) FILTER (hit = 1)]) AS y,
      unnest([avg(mean_similarity) FILTER (hit = 0), avg(max_items) FILTER (hit = 0), avg(n_features) FILTER (hit = 0)]) AS n FROM d)""")
def _(t):
    n = cut_lineage(near(t, exclude_self=True))
    stats = A.neighbour_statistics(n, t.truth())
    f = t.context_features().groupBy("context").agg(F.count("*").alias("n_features"))
    top = W.top_n(S.vote(n, t.truth()), ["context"], "score", "item", 30)
    known = t.truth().withColumn("known", F.lit(1))
    h = top.join(known, ["context", "item"], "left").groupBy("context").agg(F.coalesce(F.max("known"), F.lit(0)).alias("hit"))
    return A.group_profile(stats.join(f, "context", "left").join(h, "context"), F.col("hit") == 1, ["mean_similarity", "max_items", "n_features"])


# ---- windows ---------------------------------------------------------------------------
@entry("w1_full_ranking", "SELECT context, item, row_number() OVER (PARTITION BY context ORDER BY score DESC, item) AS rank FROM vote_v")
def _(t):
    return W.ranked(votes(t), ["context"], "score", "item").select("context", "item", "rank")


@entry("w3_normalised_score", "SELECT context, item, round(CASE WHEN max(score) OVER (PARTITION BY context) > 0 THEN score / max(score) OVER (PARTITION BY context) ELSE 0 END, 9) AS norm_score FROM vote_v")
def _(t):
    return W.share_of_best(votes(t), ["context"], "score").select("context", "item", F.round("norm_score", 9).alias("norm_score"))


@entry("w4_quantile_groups", "SELECT item, size, part, CASE WHEN price <= c1 THEN 0 WHEN price <= c2 THEN 1 ELSE 2 END AS band FROM (SELECT *, ntile(4) OVER (ORDER BY size, item) AS part FROM items_v), (SELECT quantile_cont(price, 0.33) AS c1, quantile_cont(price, 0.67) AS c2 FROM items_v)")
def _(t):
    i = W.quantile_groups(t.items().select("item", "size", "price"), [F.col("size"), F.col("item")], 4)
    return W.quantile_cuts(i, "price", [0.33, 0.67]).select("item", "size", "part", "band")


@entry("w5_fixed_buckets", "SELECT CASE WHEN rank <= 5 THEN '1-5' WHEN rank <= 10 THEN '6-10' WHEN rank <= 15 THEN '11-15' WHEN rank <= 20 THEN '16-20' WHEN rank <= 25 THEN '21-25' ELSE '26-30' END AS bucket, count(*) AS n, sum(hit) AS hits, round(avg(hit) * 100, 4) AS precision_pct FROM loo_hits_v GROUP BY 1")
def _(t):
    return A.precision_by(hits(t).withColumn("bucket", W.rank_bucket(F.col("rank"))), ["bucket"])


view("base_tier_v", """
  SELECT l.context, l.item, l.score, l.rank, l.hit, coalesce(f.train_frequency, 0) AS freq, CASE WHEN rank > 20 THEN 'FILTER' WHEN coalesce(train_frequency, 0) >= 12 THEN 'HIGH' WHEN coalesce(train_frequency, 0) >= 9 THEN 'MEDIUM' ELSE 'LOW' END AS tier
  FROM loo_hits_v l LEFT JOIN frequency_v f USING (item)""")


def base_tier(t):
    f = F.col("train_frequency")
    return hits(t).join(A.frequency(t.truth()), "item", "left").withColumn("train_frequency", F.coalesce(f, F.lit(0))).withColumn(
        "tier", F.when(F.col("rank") > 20, "FILTER").when(f >= 12, "HIGH").when(f >= 9, "MEDIUM").otherwise("LOW"))


@entry("w6_halves_in_tier", """
  SELECT tier, half, count(*) AS n, sum(hit) AS hits, round(avg(hit) * 100, 4) AS precision_pct FROM (SELECT tier, hit, CASE WHEN c = 1 OR r <= floor(c / 2) THEN 'top' ELSE 'bottom' END AS half FROM (
    SELECT *, row_number() OVER (PARTITION BY context, tier ORDER BY score DESC, item) AS r, count(*) OVER (PARTITION BY context, tier) AS c FROM base_tier_v)) GROUP BY 1, 2""")
def _(t):
    return A.precision_by(W.halves(base_tier(t), ["context", "tier"], "score", "item"), ["tier", "half"])


@entry("w7_tier_first_rank", "SELECT context, item, tier, row_number() OVER (PARTITION BY context ORDER BY list_position(['GOLDEN', 'HIGH', 'MEDIUM', 'LOW', 'FILTER'], tier), score DESC, item) AS rank FROM tiered_v")
def _(t):
    return W.tier_first_rank(tiered(t).drop("rank"), ["context"], "score", "item").select("context", "item", "tier", "rank")


@entry("w8_best_row_per_key", "SELECT item, context, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, context) AS r FROM top_v) WHERE r = 1")
def _(t):
    return W.best_row(top_items(t).select("item", "context", "score", "rank"), ["item"], "item", "score", "context")


@entry("w9_threshold_sweep", "SELECT threshold, count(*) AS n, sum(hit) AS hits, round(avg(hit) * 100, 4) AS precision_pct FROM (SELECT unnest([3, 4, 5, 6, 7, 8, 9]) AS threshold), (SELECT hit, score FROM loo_hits_v) WHERE score * 10 >= threshold GROUP BY 1")
def _(t):
    th = F.explode(F.array(*[F.lit(x) for x in range(3, 10)])).alias("threshold")
    return A.precision_by(hits(t).select("hit", "score", th).where(F.col("score") * 10 >= F.col("threshold")), ["threshold"])


@entry("w10_trailing_run", "SELECT user_id, count(*) FILTER (s = 0) AS run FROM (SELECT user_id, sum(CASE WHEN event_type IN ('view', 'click', 'signup') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS s FROM events) GROUP BY 1")
def _(t):
    return W.trailing_run(t.raw("events"), ["user_id"], "event_id", ~F.col("event_type").isin("view", "click", "signup"))


@entry("w11_rank_of_items", """
  SELECT context, count(*) AS wanted, count(*) FILTER (found) AS found, round(avg(rank), 6) AS mean_rank, median(rank) AS median_rank, min(rank) AS best, max(rank) AS worst FROM (
    SELECT t.context, l.rank IS NOT NULL AS found, coalesce(l.rank, coalesce(n.n, 0) + 1) AS rank FROM truth_v t LEFT JOIN loo_top_v l USING (context, item) LEFT JOIN (SELECT context, count(*) AS n FROM loo_top_v GROUP BY 1) n USING (context)) GROUP BY 1""")
def _(t):
    r = W.rank_of_items(cut_lineage(loo_top(t)), t.truth(), ["context"], "item")
    return r.groupBy("context").agg(F.count("*").alias("wanted"), F.count_if("found").alias("found"), F.round(F.avg("rank"), 6).alias("mean_rank"), F.percentile("rank", 0.5).alias("median_rank"), F.min("rank").alias("best"), F.max("rank").alias("worst"))


# ---- sets ------------------------------------------------------------------------------
@entry("u1_union_of_truth", "SELECT category, count(*) AS n FROM (SELECT context, item FROM truth_v UNION SELECT context, item FROM truth_extra_v) JOIN contexts_v USING (context) GROUP BY 1")
def _(t):
    return t.truth().union(t.truth("A")).distinct().join(t.categories(), "context").groupBy("category").agg(F.count("*").alias("n"))


@entry("u2_intersection", "SELECT context, item FROM truth_v INTERSECT SELECT context, item FROM truth_extra_v")
def _(t):
    return t.truth().intersect(t.truth("A"))


@entry("u3_difference", "SELECT context, item FROM top_v EXCEPT SELECT context, item FROM truth_v EXCEPT SELECT context, item FROM truth_extra_v")
def _(t):
    ids = ["context", "item"]
    return top_items(t).select(*ids).join(t.truth(), ids, "left_anti").join(t.truth("A"), ids, "left_anti")


@entry("u4_membership_changes", """
  SELECT coalesce(a.context, b.context) AS context, count(*) FILTER (a.item IS NULL) AS promoted, count(*) FILTER (b.item IS NULL) AS demoted, count(*) FILTER (a.item IS NOT NULL AND b.item IS NOT NULL) AS kept
  FROM (SELECT context, item FROM top_v WHERE rank <= 20) a FULL JOIN (SELECT context, item FROM loo_top_v WHERE rank <= 20) b ON a.context = b.context AND a.item = b.item GROUP BY 1""")
def _(t):
    old, new = (W.top_n(S.vote(n, t.truth()), ["context"], "score", "item", 20) for n in near_with_and_without(t))
    return W.membership_changes(old, new, ["context"], "item")
