"""K entries: similarity and nearest neighbours."""

from pyspark.sql import functions as F

from loomgraph.catalog.base import entry, view
from loomgraph.functions import vectors as V
from loomgraph.operators import similar as S
from loomgraph.operators.nearest import nearest_sets, nearest_vectors
from loomgraph.operators.pivots import nearest_exact
from loomgraph.operators.ranking import share_of_best, top_n

DIM = 64


def near(t, k=20, **kw):
    return S.nearest_contexts(t.vectors(), t.truth(), k, **kw)


def votes(t, k=20, **kw):
    return S.vote(near(t, k, **kw), t.truth())


def ranked_items(t):
    return share_of_best(top_n(votes(t), ["context"], "score", "item", 30), ["context"], "score")


def top_items(t):
    """The ranked candidates, written out once: the queries below read them several times."""
    return t.keep("top", lambda: ranked_items(t))


view("truth_vec_v", """
  SELECT t.context, t.item, c.vec AS cv, i.vec AS iv FROM truth_v t
  JOIN vectors_v c ON t.context = c.context JOIN item_vectors_v i ON t.item = i.item""")


def truth_pairs_with_vectors(t):
    c = t.vectors().select("context", V.doubles(F.col("vec")).alias("cv"))
    i = t.item_vectors().select("item", V.doubles(F.col("vec")).alias("iv"))
    return t.truth().join(c, "context").join(i, "item")


@entry("k1_pair_cosine", "SELECT context, item, round(list_cosine_similarity(cv, iv), 6) AS cosine FROM truth_vec_v")
def _(t):
    return S.pair_cosine(t.truth(), t.vectors(), t.item_vectors(), "context", "item")


@entry("k2_nearest_contexts", "SELECT context, neighbour, similarity, place FROM near_v")
def _(t):
    return near(t)


@entry("k3_similarity_vote", "SELECT context, item, score FROM vote_v")
def _(t):
    return votes(t)


@entry("k3_vote_on_items_with_vectors", """
  SELECT n.context, t.item, round(sum(n.similarity), 6) AS score FROM near_v n JOIN truth_v t ON n.neighbour = t.context
  WHERE t.item IN (SELECT item FROM item_vectors_v) GROUP BY 1, 2""")
def _(t):
    return S.vote(near(t), t.truth(), items=t.item_vectors())


@entry("w2_top_items", "SELECT context, item, score, rank, round(norm_score, 6) AS norm_score FROM top_v")
def _(t):
    return ranked_items(t).withColumn("norm_score", F.round("norm_score", 6))


view("boosted_near_v", """
  SELECT context, neighbour, similarity, place FROM (
    SELECT *, row_number() OVER (PARTITION BY context ORDER BY similarity DESC, neighbour) AS place FROM (
      SELECT q.context, t.context AS neighbour, round(list_cosine_similarity(q.vec, t.vec) *
        CASE WHEN a.category = b.category AND a.category IN ('furniture', 'machinery') THEN 1.5 ELSE 1 END, 6) AS similarity
      FROM vectors_v q, train_v t, contexts_v a, contexts_v b
      WHERE a.context = q.context AND b.context = t.context)) WHERE place <= 20""")


@entry("k4_category_boosted_neighbours", "SELECT * FROM boosted_near_v")
def _(t):
    v = t.vectors().join(t.categories(), "context")
    return S.nearest_contexts(v, t.truth(), 20, boosted=("furniture", "machinery"), boost=0.5)


view("context_groups_v", "SELECT DISTINCT context, grp AS feature FROM context_features_v JOIN feature_groups_v USING (feature)")
view("context_brands_v", "SELECT DISTINCT context, class2 AS feature FROM truth_v JOIN items_v USING (item)")


def context_kinds(t):
    groups = t.context_features().join(t.feature_groups(), "feature").select("context", F.col("grp").alias("feature")).distinct()
    brands = t.truth().join(t.items().select("item", "class2"), "item").select("context", F.col("class2").alias("feature")).distinct()
    return {
        "phenotypes": (brands, 0.3), "genes": (t.context_features(), 0.4), "pathways": (groups, 0.2),
        "treatments": (t.truth().select("context", F.col("item").alias("feature")), 0.1),
    }


def _jac(table, feature="feature"):
    return f"""(SELECT p.context, p.neighbour,
      CASE WHEN coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(s.n, 0) > 0
           THEN coalesce(s.n, 0) / (coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(s.n, 0)) ELSE 0 END AS j
      FROM near_v p
      LEFT JOIN (SELECT context, count(*) AS n FROM {table} GROUP BY 1) a ON a.context = p.context
      LEFT JOIN (SELECT context, count(*) AS n FROM {table} GROUP BY 1) b ON b.context = p.neighbour
      LEFT JOIN (SELECT n.context, n.neighbour, count(*) AS n FROM near_v n JOIN {table} x ON x.context = n.context
                 JOIN {table} y ON y.context = n.neighbour AND x.{feature} = y.{feature} GROUP BY 1, 2) s
        ON s.context = p.context AND s.neighbour = p.neighbour)"""


@entry("k5_weighted_jaccard", f"""
  SELECT a.context, a.neighbour, round(a.j * 0.3 + b.j * 0.4 + c.j * 0.2 + d.j * 0.1, 6) AS similarity
  FROM {_jac('context_brands_v')} a JOIN {_jac('context_features_v')} b USING (context, neighbour)
  JOIN {_jac('context_groups_v')} c USING (context, neighbour)
  JOIN {_jac('truth_v', 'item')} d USING (context, neighbour)""")
def _(t):
    return S.weighted_jaccard(near(t).select("context", "neighbour"), context_kinds(t))


view("set_pairs_v", """
  SELECT x.context, y.context AS neighbour, count(*) AS shared FROM context_features_v x
  JOIN context_features_v y ON x.feature = y.feature AND x.context <> y.context GROUP BY 1, 2""")
view("set_near_v", """
  SELECT context, neighbour, similarity, place FROM (
    SELECT *, row_number() OVER (PARTITION BY context ORDER BY similarity DESC, neighbour) AS place FROM (
      SELECT p.context, p.neighbour, round(shared / (a.n + b.n - shared), 6) AS similarity FROM set_pairs_v p
      JOIN (SELECT context, count(*) AS n FROM context_features_v GROUP BY 1) a ON a.context = p.context
      JOIN (SELECT context, count(*) AS n FROM context_features_v GROUP BY 1) b ON b.context = p.neighbour)
    WHERE similarity >= 0.1) WHERE place <= 10""")


def set_near(t, k=10, floor=0.1):
    sets = t.context_features().select(F.col("context").alias("id"), "feature")
    return nearest_sets(sets, sets, k, exclude_self=True, min_score=floor)


@entry("k6_similar_above_floor", "SELECT * FROM set_near_v")
def _(t):
    return set_near(t)


view("known_pairs_v", "SELECT v.context, v.item, k.item AS known FROM top_v v JOIN truth_v k ON v.context = k.context AND v.item <> k.item")
view("fingerprint_best_v", """
  SELECT context, item, max(similarity) AS best, arg_max(known, (similarity, -known)) AS best_match,
         count(*) FILTER (similarity > 0.7) AS above_70, count(*) FILTER (similarity > 0.5) AS above_50 FROM (
    SELECT p.*, round(coalesce(s.n, 0) / (a.n + b.n - coalesce(s.n, 0)), 6) AS similarity FROM known_pairs_v p
    JOIN (SELECT item, count(*) AS n FROM item_features_v GROUP BY 1) a ON a.item = p.item
    JOIN (SELECT item, count(*) AS n FROM item_features_v GROUP BY 1) b ON b.item = p.known
    LEFT JOIN (SELECT d.item, d.known, count(*) AS n FROM (SELECT DISTINCT item, known FROM known_pairs_v) d
          JOIN item_features_v x ON x.item = d.item
          JOIN item_features_v y ON y.item = d.known AND x.feature = y.feature GROUP BY 1, 2) s
      ON s.item = p.item AND s.known = p.known) GROUP BY 1, 2""")


def fingerprint_best(t):
    return S.best_known_match(top_items(t).select("context", "item"), t.truth(), t.item_features())


@entry("k7_tanimoto_best_match", "SELECT context, item, best, best_match FROM fingerprint_best_v")
def _(t):
    return fingerprint_best(t).select("context", "item", "best", "best_match")


view("translation_v", """
  SELECT context, item, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY context ORDER BY score DESC, item) AS rank FROM (
      SELECT c.context, i.item, -round(list_distance(list_transform(c.vec, lambda x: x - 0.1), i.vec), 6) AS score
      FROM vectors_v c, item_vectors_v i)) WHERE rank <= 30""")


def translation(t):
    return S.translation_top(t.vectors(), t.item_vectors(), [0.1] * DIM, 30)


@entry("k8_translation_ranking", "SELECT * FROM translation_v")
def _(t):
    return translation(t)


@entry("k9_rotation_complex_trilinear", """
  SELECT context, item,
    round(list_sum(list_transform(list_zip(iv, cv), lambda z: 0.5 * z[1] * z[2])), 6) AS trilinear,
    round(0.6 * list_dot_product(iv, cv) + 0.8 * (list_dot_product(iv[1:32], cv[33:64]) - list_dot_product(iv[33:64], cv[1:32])), 6) AS complex,
    round(-list_sum(list_transform(list_zip(iv[1:32], iv[33:64], cv[1:32], cv[33:64]),
      lambda z: sqrt(pow(z[1] * cos(0.3) - z[2] * sin(0.3) - z[3], 2) + pow(z[1] * sin(0.3) + z[2] * cos(0.3) - z[4], 2) + 1e-8))), 6) AS rotation
  FROM truth_vec_v""")
def _(t):
    def const(*values_counts):
        return F.array(*[F.lit(float(v)) for v, n in values_counts for _ in range(n)])

    half = DIM // 2
    h, c = F.col("iv"), F.col("cv")
    return truth_pairs_with_vectors(t).select(
        "context", "item",
        F.round(V.trilinear_score(h, const((0.5, DIM)), c), 6).alias("trilinear"),
        F.round(V.complex_score(h, const((0.6, half), (0.8, half)), c, DIM), 6).alias("complex"),
        F.round(V.rotation_score(h, const((0.3, half)), c, DIM), 6).alias("rotation"),
    )


view("hybrid_v", f"""
  SELECT n.context, n.neighbour, round(0.3 * round(j.j, 6) + 0.7 * n.similarity, 9) AS similarity
  FROM near_v n JOIN {_jac('context_features_v')} j USING (context, neighbour)""")


@entry("k10_hybrid_similarity", "SELECT * FROM hybrid_v")
def _(t):
    pairs = t.keep("near", lambda: near(t))
    right = S.renamed_feature(t.context_features(), "context", "neighbour")
    sets = S.pair_jaccard(pairs.select("context", "neighbour"), t.context_features(), right, "context", "neighbour", "similarity")
    return S.hybrid_similarity(sets, pairs, 0.3)


@entry("k11_pluggable_similarity_vote", """
  SELECT context, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY score DESC, item) AS rank FROM (
    SELECT n.context, t.item, round(sum(n.similarity), 6) AS score FROM set_near_v n JOIN truth_v t ON t.context = n.neighbour
    GROUP BY 1, 2)) WHERE rank <= 30""")
def _(t):
    return top_n(S.vote_any(set_near(t).drop("place"), t.truth(), 10), ["context"], "score", "item", 30)


view("draws_v", """
  SELECT draw, context FROM (
    SELECT draw, context, row_number() OVER (PARTITION BY draw ORDER BY
             ('0x' || substr(md5('42:' || draw || ':' || context), 1, 8))::BIGINT, context) AS r,
           count(*) OVER (PARTITION BY draw) AS n
    FROM train_v, (SELECT unnest(range(1, 11)) AS draw)) WHERE r <= floor(n * 0.8)""")


@entry("k12_subsample_votes", """
  SELECT context, item, round(sum(similarity) / 10, 9) AS score FROM (
    SELECT draw, context, neighbour, similarity, row_number() OVER (PARTITION BY draw, context ORDER BY similarity DESC, neighbour) AS place
    FROM pairs_v p JOIN draws_v d ON d.context = p.neighbour AND p.context IS NOT NULL) n(draw, context, neighbour, similarity, place)
  JOIN truth_v t ON t.context = n.neighbour WHERE place <= 20 GROUP BY n.context, t.item""".replace(
    "SELECT context, item, round", "SELECT n.context AS context, t.item AS item, round").replace(
    "SELECT draw, context, neighbour", "SELECT d.draw, p.context, neighbour").replace(
    "PARTITION BY draw, context ORDER", "PARTITION BY d.draw, p.context ORDER"))
def _(t):
    return S.subsample_votes(t.vectors(), t.truth())


view("near30_v", """
  SELECT context, neighbour, similarity, place FROM (
    SELECT *, row_number() OVER (PARTITION BY context ORDER BY similarity DESC, neighbour) AS place FROM pairs_v) WHERE place <= 30""")
view("multi_k_v", """
  SELECT n.context, k, t.item, round(sum(similarity), 6) AS score FROM near30_v n, (SELECT unnest([15, 20, 25, 30]) AS k) ks, truth_v t
  WHERE place <= k AND t.context = n.neighbour GROUP BY 1, 2, 3""")


@entry("k13_multi_k_average_and_borda", """
  SELECT context, item, round(sum(CASE WHEN best > 0 THEN score / best ELSE 0 END) / 4, 9) AS mean_score,
         round(sum(CASE WHEN r <= 30 THEN (30 - r) / 30 ELSE 0 END), 9) AS borda FROM (
    SELECT *, max(score) OVER (PARTITION BY context, k) AS best,
           row_number() OVER (PARTITION BY context, k ORDER BY score DESC, item) AS r FROM multi_k_v) GROUP BY 1, 2""")
def _(t):
    return S.multi_k_scores(near(t, 30), t.truth())


K_OF = {"furniture": 5, "household": 10, "machinery": 15, "building": 30}


@entry("k14_category_specific_k", """
  SELECT n.context, t.item, round(sum(similarity), 6) AS score FROM near30_v n JOIN contexts_v c ON c.context = n.context
  JOIN truth_v t ON t.context = n.neighbour
  WHERE place <= CASE category WHEN 'furniture' THEN 5 WHEN 'household' THEN 10 WHEN 'machinery' THEN 15 WHEN 'building' THEN 30 ELSE 20 END
  GROUP BY 1, 2""")
def _(t):
    return S.vote(S.own_k(near(t, 30), t.categories(), K_OF, 20), t.truth())


view("loo_near_v", """
  SELECT context, neighbour, similarity, place FROM (
    SELECT *, row_number() OVER (PARTITION BY context ORDER BY similarity DESC, neighbour) AS place
    FROM pairs_v WHERE context <> neighbour) WHERE place <= 20""")
view("loo_top_v", """
  SELECT context, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY score DESC, item) AS rank FROM (
    SELECT n.context, t.item, round(sum(n.similarity), 6) AS score FROM loo_near_v n JOIN truth_v t ON t.context = n.neighbour
    GROUP BY 1, 2)) WHERE rank <= 30""")


def near_with_and_without(t, k=20):
    """The k nearest with and without the context itself, from one comparison: the k + 1 nearest hold both."""
    both = t.keep(f"near_{k + 1}", lambda: near(t, k + 1))
    return both.where(F.col("place") <= k), S.without_self(both, k)


def loo_top(t):
    return top_n(votes(t, exclude_self=True), ["context"], "score", "item", 30)


@entry("k15_leave_one_out_hits", """
  SELECT l.context, count(*) AS predicted, count(t.item) AS hits, CASE WHEN count(t.item) > 0 THEN 1 ELSE 0 END AS hit
  FROM loo_top_v l LEFT JOIN truth_v t ON t.context = l.context AND t.item = l.item GROUP BY 1""")
def _(t):
    known = t.truth().withColumn("known", F.lit(1))
    return loo_top(t).join(known, ["context", "item"], "left").groupBy("context").agg(
        F.count("*").alias("predicted"), F.count("known").alias("hits"), F.coalesce(F.max("known"), F.lit(0)).alias("hit"))


@entry("k16_similar_items", """
  SELECT item, other, similarity, place FROM (
    SELECT a.item, b.item AS other, round(list_cosine_similarity(a.vec, b.vec), 6) AS similarity,
      row_number() OVER (PARTITION BY a.item ORDER BY round(list_cosine_similarity(a.vec, b.vec), 6) DESC, b.item) AS place
    FROM item_vectors_v a JOIN item_vectors_v b ON a.item <> b.item) WHERE place <= 10""")
def _(t):
    p = S.as_points(t.item_vectors(), "item")
    return nearest_exact(p, p, 10, p.count(), exclude_self=True, names=("item", "other", "similarity"))


view("coherence_v", """
  SELECT n.context, a.category, round(avg(CASE WHEN a.category = b.category THEN 1.0 ELSE 0.0 END), 6) AS coherence
  FROM loo_near_v n JOIN contexts_v a ON a.context = n.context JOIN contexts_v b ON b.context = n.neighbour GROUP BY 1, 2""")


@entry("k17_neighbour_category_share", "SELECT * FROM coherence_v")
def _(t):
    return S.neighbour_category_share(near(t, exclude_self=True), t.categories())


@entry("k18_shared_item_density", """
  SELECT context, round(avg(shared), 6) AS mean_shared, round(avg(shared / (na + nb - shared)), 6) AS mean_jaccard FROM (
    SELECT p.context, p.neighbour, coalesce(s.n, 0) AS shared, coalesce(a.n, 0) AS na, b.n AS nb FROM loo_near_v p
    LEFT JOIN (SELECT context, count(*) AS n FROM truth_v GROUP BY 1) a ON a.context = p.context
    LEFT JOIN (SELECT context, count(*) AS n FROM truth_v GROUP BY 1) b ON b.context = p.neighbour
    LEFT JOIN (SELECT n.context, n.neighbour, count(*) AS n FROM loo_near_v n JOIN truth_v x ON x.context = n.context
               JOIN truth_v y ON y.context = n.neighbour AND x.item = y.item GROUP BY 1, 2) s
      ON s.context = p.context AND s.neighbour = p.neighbour) GROUP BY 1""")
def _(t):
    return S.shared_item_density(near(t, exclude_self=True), t.truth())


@entry("k19_centrality", """
  SELECT a.context, round(avg(list_cosine_similarity(a.vec, b.vec)), 6) AS centrality
  FROM vectors_v a JOIN vectors_v b ON a.context <> b.context GROUP BY 1""")
def _(t):
    return S.centrality(t.vectors())


@entry("k20_class_coherence", """
  WITH hits AS (SELECT DISTINCT p.context, t.item, i.class2 FROM pairs_v p JOIN truth_v t ON t.context = p.neighbour
                JOIN items_v i ON i.item = t.item WHERE p.similarity >= 0.3),
       sizes AS (SELECT class2, count(*) AS n FROM items_v GROUP BY 1),
       per AS (SELECT context, class2, count(*) AS n FROM hits GROUP BY 1, 2)
  SELECT v.context, v.item, CASE WHEN s.n <= 1 THEN -1.0 ELSE
      round((coalesce(per.n, 0) - CASE WHEN h.item IS NULL THEN 0 ELSE 1 END) / (s.n - 1), 6) END AS coherence
  FROM top_v v JOIN items_v i ON i.item = v.item JOIN sizes s ON s.class2 = i.class2
  LEFT JOIN per ON per.context = v.context AND per.class2 = i.class2
  LEFT JOIN hits h ON h.context = v.context AND h.item = v.item""")
def _(t):
    classes = t.items().select("item", F.col("class2").alias("cls"))
    return S.class_coherence(top_items(t).select("context", "item"), t.vectors(), t.truth(), classes, 0.3)


@entry("k21_class_transfer", """
  WITH ref AS (SELECT n.context, t.item, n.similarity FROM near_v n JOIN truth_v t ON t.context = n.neighbour),
       cls AS (SELECT context, class2, round(sum(similarity), 6) AS cs FROM ref JOIN items_v USING (item) GROUP BY 1, 2)
  SELECT context, item, score, rank FROM (
    SELECT c.context, i.item, round(c.cs, 6) AS score, row_number() OVER (PARTITION BY c.context ORDER BY round(c.cs, 6) DESC, i.item) AS rank
    FROM cls c JOIN items_v i ON i.class2 = c.class2
    WHERE NOT EXISTS (SELECT 1 FROM ref r WHERE r.context = c.context AND r.item = i.item)) WHERE rank <= 30""")
def _(t):
    return S.class_transfer(near(t), t.truth(), t.items().select("item", F.col("class2").alias("cls")))


view("similarity_mean_v", """
  SELECT context, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY score DESC, item) AS rank FROM (
    SELECT context, item, ((2 * s + n - (2 * s + n) % (2 * n)) // (2 * n)) / 1e6 AS score FROM (
      SELECT n.context, t.item, sum(round(similarity * 1e6)::BIGINT)::BIGINT AS s, count(*) AS n FROM set_near_v n JOIN truth_v t ON t.context = n.neighbour
      GROUP BY 1, 2))) WHERE rank <= 30""")


@entry("k22_similarity_transfer_merged", """
  SELECT coalesce(a.context, b.context) AS context, coalesce(a.item, b.item) AS item,
    round(CASE WHEN a.score IS NULL THEN b.score WHEN b.score IS NULL THEN a.score ELSE (a.score + b.score) / 2 END, 9) AS score
  FROM similarity_mean_v a FULL JOIN top_v b ON a.context = b.context AND a.item = b.item""")
def _(t):
    return S.merge_average(S.similarity_mean(set_near(t), t.truth()), top_items(t))


@entry("k23_cross_category_boost", """
  SELECT v.context, v.item, round(v.score * CASE WHEN d.n >= 4 THEN 1.5 ELSE 1 END, 9) AS score FROM vote_v v
  LEFT JOIN (SELECT item, count(DISTINCT category) AS n FROM truth_v JOIN contexts_v USING (context) GROUP BY 1) d USING (item)""")
def _(t):
    return S.cross_category_boost(votes(t), t.truth(), t.categories(), 4, 1.5)


@entry("k24_attention_transfer", """
  WITH w AS (SELECT context, neighbour, exp(similarity) / sum(exp(similarity)) OVER (PARTITION BY context) AS weight FROM near_v),
       near_items AS (SELECT a.item, b.item AS other FROM item_vectors_v a, item_vectors_v b
                      WHERE round(list_cosine_similarity(a.vec, b.vec), 6) > 0.8)
  SELECT context, item, round(sum(weight), 4) AS score FROM (
    SELECT DISTINCT v.context, v.item, w.neighbour, w.weight FROM top_v v JOIN near_items s ON s.item = v.item
    JOIN w ON w.context = v.context JOIN truth_v t ON t.context = w.neighbour AND t.item = s.other) GROUP BY 1, 2""")
def _(t):
    return S.attention_transfer(near(t), t.truth(), t.item_vectors(), top_items(t))


@entry("k25_class_boost", """
  WITH pool AS (SELECT v.context, i.class1, count(*) AS n FROM vote_v v JOIN items_v i USING (item) GROUP BY 1, 2),
       dom AS (SELECT context, class1 FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY n DESC, class1) AS r FROM pool) WHERE r <= 3)
  SELECT v.context, v.item, round(v.score * CASE WHEN d.class1 IS NULL THEN 1 ELSE 1.5 END, 9) AS score
  FROM vote_v v JOIN items_v i USING (item) LEFT JOIN dom d ON d.context = v.context AND d.class1 = i.class1""")
def _(t):
    return S.dominant_class_boost(votes(t), t.items().select("item", F.col("class1").alias("cls")), 3, 0.5)


@entry("k26_similarity_to_known", """
  WITH known AS (SELECT a.context, a.item, list_cosine_similarity(a.iv, b.iv) AS s FROM truth_vec_v a JOIN truth_vec_v b
                 ON a.context = b.context AND a.item <> b.item),
       uses AS (SELECT a.context, a.item, list_cosine_similarity(a.cv, b.cv) AS s FROM truth_vec_v a JOIN truth_vec_v b
                ON a.item = b.item AND a.context <> b.context)
  SELECT p.context, p.item, coalesce(k.mx, 0) AS max_item, coalesce(k.av, 0) AS mean_item, coalesce(u.mx, 0) AS max_context, coalesce(u.av, 0) AS mean_context
  FROM truth_vec_v p
  LEFT JOIN (SELECT context, item, round(max(s), 6) AS mx, round(avg(s), 6) AS av FROM known GROUP BY 1, 2) k USING (context, item)
  LEFT JOIN (SELECT context, item, round(max(s), 6) AS mx, round(avg(s), 6) AS av FROM uses GROUP BY 1, 2) u USING (context, item)""")
def _(t):
    return S.similarity_to_known(t.truth(), t.vectors(), t.item_vectors())


@entry("k27_direct_vector_ranking", """
  SELECT context, item, score, place FROM (
    SELECT c.context, i.item, round(list_cosine_similarity(c.vec, i.vec), 6) AS score,
      row_number() OVER (PARTITION BY c.context ORDER BY round(list_cosine_similarity(c.vec, i.vec), 6) DESC, i.item) AS place
    FROM vectors_v c, item_vectors_v i) WHERE place <= 30""")
def _(t):
    return nearest_vectors(S.as_points(t.vectors()), S.as_points(t.item_vectors(), "item"), 30, names=("context", "item", "score"))
