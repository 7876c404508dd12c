"""G entries: joins and paths over the edge table."""

from pyspark.sql import functions as F

from loomgraph.catalog.base import entry, view
from loomgraph.catalog.similarity import set_near, top_items
from loomgraph.operators import graph as G
from loomgraph.operators import paths as P
from loomgraph.operators import similar as S
from loomgraph.session import cut_lineage

ids = ["context", "item"]


def pairs(t):
    return top_items(t).select("context", "item")


@entry("g1_linked_features", """
  SELECT DISTINCT split_part(source, '::', 2) AS item, split_part(target, '::', 2) AS feature FROM edges_v WHERE relation = 'targets'""")
def _(t):
    return G.links(t.edges(), ["targets"], "Item", "Feature", "item", "feature")


@entry("g1_linked_features_reverse", """
  SELECT DISTINCT split_part(target, '::', 2) AS feature, split_part(source, '::', 2) AS context FROM edges_v WHERE relation = 'associated_with'""")
def _(t):
    return G.links(t.edges(), ["associated_with"], "Feature", "Context", "feature", "context")


view("shared_v", """
  SELECT v.context, v.item, coalesce(s.n, 0) AS n_shared, coalesce(s.shared, '') AS shared FROM top_v v LEFT JOIN (
    SELECT v.context, v.item, count(*) AS n, string_agg(i.feature::VARCHAR, ',' ORDER BY i.feature) AS shared FROM top_v v
    JOIN item_features_v i ON i.item = v.item JOIN context_features_v c ON c.context = v.context AND c.feature = i.feature
    GROUP BY 1, 2) s ON s.context = v.context AND s.item = v.item""")


@entry("g2_shared_features", "SELECT * FROM shared_v")
def _(t):
    return G.shared_features(pairs(t), t.item_features(), t.context_features())


view("item_groups_v", "SELECT DISTINCT item, grp AS feature FROM item_features_v JOIN feature_groups_v USING (feature)")
view("shared_groups_v", """
  SELECT v.context, v.item, coalesce(s.n, 0) AS n_shared, coalesce(s.shared, '') AS shared FROM top_v v LEFT JOIN (
    SELECT v.context, v.item, count(*) AS n, string_agg(i.feature::VARCHAR, ',' ORDER BY i.feature) AS shared FROM top_v v
    JOIN item_groups_v i ON i.item = v.item JOIN context_groups_v c ON c.context = v.context AND c.feature = i.feature
    GROUP BY 1, 2) s ON s.context = v.context AND s.item = v.item""")


def item_groups(t):
    return G.group_sets(t.item_features(), t.feature_groups(), "item")


def context_groups(t):
    return G.group_sets(t.context_features(), t.feature_groups(), "context")


def shared_groups(t):
    return G.shared_features(pairs(t), item_groups(t), context_groups(t))


@entry("g3_shared_groups", "SELECT * FROM shared_groups_v")
def _(t):
    return shared_groups(t)


def overlap_sql(contexts, items):
    return f"""SELECT context, item, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY context ORDER BY score DESC, item) AS rank FROM (
        SELECT c.context, i.item, count(*) AS score FROM {contexts} c JOIN {items} i USING (feature) GROUP BY 1, 2)) WHERE rank <= 30"""


view("mechanism_v", overlap_sql("context_features_v", "item_features_v"))


def mechanism(t):
    return G.overlap_top(t.context_features(), t.item_features())


def mechanism_of_vectors(t):
    """The ranking of the contexts with a vector alone; other contexts don't change it."""
    return G.overlap_top(t.context_features().join(t.vectors().select("context"), "context", "left_semi"), t.item_features())


@entry("g4_mechanism_ranking", "SELECT * FROM mechanism_v")
def _(t):
    return mechanism(t)


@entry("g5_group_ranking", overlap_sql("context_groups_v", "item_groups_v"))
def _(t):
    return G.overlap_top(context_groups(t), item_groups(t))


view("net_both_v", "SELECT a AS x, b AS y FROM feature_net_v UNION SELECT b, a FROM feature_net_v")


@entry("g6_two_hop_mechanism", """
  SELECT v.context, v.item, count(*) AS n_paths, count(DISTINCT i.feature) AS n_starts FROM top_v v
  JOIN item_features_v i ON i.item = v.item JOIN net_both_v n ON n.x = i.feature
  JOIN context_features_v c ON c.context = v.context AND c.feature = n.y
  WHERE NOT EXISTS (SELECT 1 FROM context_features_v d WHERE d.context = v.context AND d.feature = i.feature) GROUP BY 1, 2""")
def _(t):
    return G.two_hop_paths(pairs(t), t.item_features(), t.feature_net(), t.context_features()).groupBy(*ids).agg(
        F.count("*").alias("n_paths"), F.countDistinct("feature").alias("n_starts"))


view("extended2_v", """
  SELECT item, feature FROM item_features_v UNION SELECT item, n.y FROM item_features_v i JOIN net_both_v n ON n.x = i.feature
  UNION SELECT item, m.y FROM item_features_v i JOIN net_both_v n ON n.x = i.feature JOIN net_both_v m ON m.x = n.y""")


@entry("g7_extended_features", "SELECT * FROM extended2_v")
def _(t):
    return G.extended_features(t.item_features(), t.feature_net(), "item", 2)


view("extended1_v", "SELECT item, feature FROM item_features_v UNION SELECT item, n.y FROM item_features_v i JOIN net_both_v n ON n.x = i.feature")


@entry("g8_group_weighted_overlap", """
  WITH hit AS (SELECT v.context, v.item, e.feature FROM top_v v JOIN extended1_v e ON e.item = v.item
               JOIN context_features_v c ON c.context = v.context AND c.feature = e.feature),
       ig AS (SELECT DISTINCT item, grp FROM item_features_v JOIN feature_groups_v USING (feature))
  SELECT v.context, v.item, coalesce(s.score, 0) AS score FROM top_v v LEFT JOIN (
    SELECT h.context, h.item, sum(CASE WHEN g.grp IS NULL THEN 0.5 ELSE 1.0 END) AS score FROM hit h
    JOIN feature_groups_v f USING (feature) LEFT JOIN ig g ON g.item = h.item AND g.grp = f.grp GROUP BY 1, 2) s
  ON s.context = v.context AND s.item = v.item""")
def _(t):
    own = G.weighted_overlap
    grown = G.extended_features(t.item_features(), t.feature_net(), "item", 1)
    return own(pairs(t), grown, t.context_features(), t.feature_groups(), item_groups_of=t.item_features())


view("path_pairs_v", "SELECT DISTINCT source, target FROM (SELECT min(feature) AS source, max(feature) AS target FROM context_features_v GROUP BY context) WHERE source <> target")
view("bfs_v", """
  SELECT source, source AS node, [source] AS path, 0 AS length FROM (SELECT DISTINCT source FROM path_pairs_v)
  UNION ALL
  SELECT b.source, n.y, list_append(b.path, n.y), b.length + 1 FROM bfs_v b JOIN net_both_v n ON n.x = b.node
  WHERE b.length < 4 AND NOT list_contains(b.path, n.y)""", recursive=True)


def path_pairs(t):
    p = t.context_features().groupBy("context").agg(F.min("feature").alias("source"), F.max("feature").alias("target"))
    return p.where(F.col("source") != F.col("target")).select("source", "target").distinct()


@entry("g9_shortest_path", """
  SELECT p.source, p.target, b.length, array_to_string(b.path, '-') AS path FROM path_pairs_v p LEFT JOIN (
    SELECT source, node, min(length) AS length, arg_min(path, (length, path)) AS path FROM bfs_v GROUP BY 1, 2) b
  ON b.source = p.source AND b.node = p.target""")
def _(t):
    return P.shortest_paths(path_pairs(t), t.feature_net(), 4).select(
        "source", "target", "length", F.when(F.col("path").isNotNull(), F.concat_ws("-", F.col("path").cast("array<string>"))).alias("path"))


view("walk_v", """
  SELECT context, feature AS node, 0 AS distance FROM context_features_v
  UNION SELECT w.context, n.y, w.distance + 1 FROM walk_v w JOIN net_both_v n ON n.x = w.node WHERE w.distance < 6""", recursive=True)


@entry("g10_set_distance", """
  SELECT v.context, v.item, d.min_distance, d.mean_distance FROM top_v v LEFT JOIN (
    SELECT v.context, v.item, min(w.distance) AS min_distance, round(avg(w.distance), 6) AS mean_distance FROM top_v v
    JOIN item_features_v i ON i.item = v.item
    JOIN (SELECT context, node, min(distance) AS distance FROM walk_v GROUP BY 1, 2) w ON w.context = v.context AND w.node = i.feature
    GROUP BY 1, 2) d ON d.context = v.context AND d.item = v.item""")
def _(t):
    wanted = pairs(t).select(*ids).join(t.item_features(), "item").select("context", F.col("feature").alias("node")).distinct()
    d = P.set_distances(wanted, t.context_features(), t.feature_net(), "context", 6)
    return P.pair_distances(pairs(t), d, t.item_features())


view("path_edges_v", """
  SELECT source, relation, target FROM edges_v WHERE relation IN ('targets', 'interacts_with', 'treats')
  UNION ALL SELECT target, relation, source FROM edges_v WHERE relation = 'associated_with'""")
view("hops_v", "SELECT source AS x, target AS y, min(relation) AS relation FROM path_edges_v GROUP BY 1, 2")
view("inner_hops_v", "SELECT * FROM hops_v WHERE starts_with(x, 'Feature::') AND starts_with(y, 'Feature::')")
view("pair_nodes_v", "SELECT 'Item::' || item AS source, 'Context::' || context AS target FROM top_v")
view("paths_v", """
  SELECT source, target, nodes, relations, len(relations) AS length, place, n_paths FROM (
    SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY len(relations), nodes) AS place, count(*) OVER (PARTITION BY source, target) AS n_paths FROM (
      SELECT p.source, p.target, [a.x, a.y] AS nodes, [a.relation] AS relations FROM pair_nodes_v p JOIN hops_v a ON a.x = p.source AND a.y = p.target
      UNION ALL
      SELECT p.source, p.target, [a.x, a.y, b.y], [a.relation, b.relation] FROM pair_nodes_v p JOIN hops_v b ON b.y = p.target
        JOIN hops_v a ON a.x = p.source AND a.y = b.x WHERE a.y <> p.target
      UNION ALL
      SELECT p.source, p.target, [a.x, a.y, b.y, c.y], [a.relation, b.relation, c.relation] FROM pair_nodes_v p JOIN hops_v c ON c.y = p.target
        JOIN hops_v b ON b.y = c.x JOIN hops_v a ON a.x = p.source AND a.y = b.x
        WHERE a.y <> p.target AND b.y <> p.target AND b.y <> p.source AND a.y <> b.y
      UNION ALL
      SELECT p.source, p.target, [a.x, a.y, b.y, c.y, d.y], [a.relation, b.relation, c.relation, d.relation] FROM pair_nodes_v p JOIN hops_v d ON d.y = p.target
        JOIN inner_hops_v c ON c.y = d.x JOIN inner_hops_v b ON b.y = c.x JOIN hops_v a ON a.x = p.source AND a.y = b.x
        WHERE a.y <> p.target AND b.y <> p.target AND c.y <> p.target AND b.y <> p.source AND c.y <> p.source
          AND a.y <> b.y AND a.y <> c.y AND b.y <> c.y)) WHERE place <= 10""")


def path_edges(t):
    e = t.edges()
    keep = e.where(F.col("relation").isin("targets", "interacts_with", "treats")).select("source", "relation", "target")
    turned = e.where(F.col("relation") == "associated_with").select(F.col("target").alias("source"), "relation", F.col("source").alias("target"))
    return keep.unionByName(turned)


def node_pairs(t):
    return pairs(t).select(F.concat(F.lit("Item::"), "item").alias("source"), F.concat(F.lit("Context::"), "context").alias("target"))


def found_paths(t):
    return P.simple_paths(node_pairs(t), path_edges(t), 4, 10)


PATH_SQL = "nodes[1] || array_to_string(list_transform(list_zip(relations, nodes[2:]), lambda z: ' -[' || z[1] || ']-> ' || z[2]), '')"


@entry("g11_simple_paths", f"SELECT source, target, {PATH_SQL} AS path, length, place FROM paths_v")
def _(t):
    return found_paths(t).select("source", "target", P.path_text(F.col("nodes"), F.col("relations")).alias("path"), "length", "place")


W = "CASE r WHEN 'treats' THEN 1.0 WHEN 'targets' THEN 0.7 WHEN 'associated_with' THEN 0.4 WHEN 'interacts_with' THEN 0.3 ELSE 0.2 END"
B = "CASE WHEN starts_with(n, 'Feature::') THEN 0.1 ELSE 0 END"
view("path_scores_v", f"""
  SELECT *, round(0.3 / length + 0.5 * list_sum(list_transform(relations, lambda r: {W})) / length + 0.2 * (
    2 * list_sum(list_transform(nodes, lambda n: {B})) - list_sum(list_transform([nodes[1], nodes[-1]], lambda n: {B}))), 6) AS score,
    {PATH_SQL} AS path FROM paths_v""")
BONUS = {"Feature": 0.1, "Group": 0.15}


@entry("g12_path_score", "SELECT source, target, place, score FROM path_scores_v")
def _(t):
    return found_paths(t).select("source", "target", "place", F.round(P.path_score(F.col("nodes"), F.col("relations"), bonus=BONUS), 6).alias("score"))


view("best_paths_v", """
  SELECT source, target, score, n_paths, best_path, row_number() OVER (PARTITION BY target ORDER BY score DESC, source) AS rank FROM (
    SELECT source, target, max(score) AS score, max(n_paths) AS n_paths, arg_max(path, (score, -place)) AS best_path FROM path_scores_v GROUP BY 1, 2)""")


@entry("g13_multi_hop_candidates", "SELECT * FROM best_paths_v WHERE rank <= 50")
def _(t):
    return P.best_paths(found_paths(t), 50, bonus=BONUS)


@entry("g14_explanation", """
  WITH n AS (SELECT source, target, max(n_paths) AS n_paths FROM paths_v GROUP BY 1, 2)
  SELECT s.context, s.item, coalesce(n.n_paths, 0) AS n_paths, s.n_shared AS n_targets, g.n_shared AS n_pathways,
    round(least(least(coalesce(n.n_paths, 0) * 0.1, 0.3) + least(s.n_shared * 0.15, 0.4) + least(g.n_shared * 0.1, 0.3), 1.0), 6) AS confidence
  FROM shared_v s JOIN shared_groups_v g USING (context, item)
  LEFT JOIN n ON n.source = 'Item::' || s.item AND n.target = 'Context::' || s.context""")
def _(t):
    n = found_paths(t).groupBy("source", "target").agg(F.max("n_paths").alias("n_paths")).select(
        F.split_part("source", F.lit("::"), F.lit(2)).cast("bigint").alias("item"),
        F.split_part("target", F.lit("::"), F.lit(2)).cast("bigint").alias("context"), "n_paths")
    a = G.shared_features(pairs(t), t.item_features(), t.context_features()).select(*ids, F.col("n_shared").alias("n_targets"))
    b = shared_groups(t).select(*ids, F.col("n_shared").alias("n_pathways"))
    out = a.join(b, ids).join(n, ids, "left").withColumn("n_paths", F.coalesce("n_paths", F.lit(0)))
    return out.select(*ids, "n_paths", "n_targets", "n_pathways", F.round(
        P.explanation_confidence(F.col("n_paths"), F.col("n_targets"), F.col("n_pathways")), 6).alias("confidence"))


@entry("g15_mechanism_trace", """
  WITH bridge AS (SELECT v.context, v.item, count(DISTINCT i.feature) AS n_bridge FROM top_v v JOIN item_features_v i ON i.item = v.item
                  JOIN feature_groups_v f ON f.feature = i.feature JOIN context_groups_v c ON c.context = v.context AND c.feature = f.grp GROUP BY 1, 2)
  SELECT s.context, s.item, CASE WHEN s.n_shared > 0 THEN 'DIRECT' ELSE 'INDIRECT' END AS mechanism, s.n_shared AS n_direct,
    g.n_shared AS n_groups, g.shared AS groups, coalesce(b.n_bridge, 0) AS n_bridge,
    CASE WHEN s.n_shared > 0 THEN 'item ' || s.item || ' directly modulates ' || s.n_shared || ' features'
         WHEN coalesce(b.n_bridge, 0) > 0 THEN 'item ' || s.item || ' reaches ' || g.n_shared || ' shared groups through ' || b.n_bridge || ' features'
         ELSE 'mechanism unclear' END AS hypothesis
  FROM shared_v s JOIN shared_groups_v g USING (context, item) LEFT JOIN bridge b USING (context, item)""")
def _(t):
    return G.mechanism_trace(pairs(t), t.item_features(), t.context_features(), t.feature_groups())


view("link_adj_v", """
  SELECT source AS x, target AS y FROM edges_v WHERE relation IN ('targets', 'associated_with', 'interacts_with')
  UNION SELECT target, source FROM edges_v WHERE relation IN ('targets', 'associated_with', 'interacts_with')""")


@entry("g16_novelty_class", """
  WITH p AS MATERIALIZED (SELECT * FROM pair_nodes_v), n AS MATERIALIZED (SELECT * FROM link_adj_v),
  l1 AS MATERIALIZED (SELECT source, target FROM p JOIN n ON x = source AND y = target),
  l2 AS MATERIALIZED (SELECT p.source, p.target, min(a.y) AS middle FROM p ANTI JOIN l1 USING (source, target) JOIN n a ON a.x = p.source JOIN n b ON b.x = p.target AND b.y = a.y GROUP BY 1, 2),
  o3 AS MATERIALIZED (SELECT * FROM p ANTI JOIN l1 USING (source, target) ANTI JOIN l2 USING (source, target)),
  l3 AS MATERIALIZED (SELECT DISTINCT p.source, p.target FROM o3 p JOIN n a ON a.x = p.source JOIN n m ON m.x = a.y JOIN n b ON b.x = p.target AND b.y = m.y),
  o4 AS MATERIALIZED (SELECT * FROM o3 ANTI JOIN l3 USING (source, target)),
  s2 AS MATERIALIZED (SELECT DISTINCT a.x AS source, m.y FROM n a JOIN n m ON m.x = a.y WHERE a.x IN (SELECT source FROM o4)),
  t2 AS MATERIALIZED (SELECT DISTINCT a.x AS target, m.y FROM n a JOIN n m ON m.x = a.y WHERE a.x IN (SELECT target FROM o4)),
  l4 AS MATERIALIZED (SELECT DISTINCT p.source, p.target FROM o4 p JOIN s2 ON s2.source = p.source JOIN t2 ON t2.target = p.target AND t2.y = s2.y),
  l AS (SELECT source, target, 1 AS length, NULL AS middle FROM l1 UNION ALL SELECT source, target, 2, middle FROM l2
        UNION ALL SELECT source, target, 3, NULL FROM l3 UNION ALL SELECT source, target, 4, NULL FROM l4)
  SELECT p.source, p.target, CASE WHEN d.context IS NOT NULL THEN 'KNOWN' WHEN b.length IS NULL THEN 'TRUE_NOVEL'
    WHEN b.length = 2 AND starts_with(b.middle, 'Item::') THEN 'DRUG_SIMILARITY' WHEN b.length = 2 AND starts_with(b.middle, 'Feature::') THEN 'MECHANISTIC'
    WHEN b.length = 2 THEN 'INDIRECT_2HOP' WHEN b.length = 3 THEN 'INDIRECT_3HOP' WHEN b.length = 4 THEN 'DISTANT' ELSE 'INDIRECT' END AS novelty, b.length
  FROM p LEFT JOIN l b ON b.source = p.source AND b.target = p.target
  LEFT JOIN truth_v d ON 'Item::' || d.item = p.source AND 'Context::' || d.context = p.target""")
def _(t):
    """The undirected search over feature links; a known pair is a pair of the truth, whatever its path."""
    known = t.truth().select(F.concat(F.lit("Item::"), "item").alias("source"), F.concat(F.lit("Context::"), "context").alias("target"), F.lit(True).alias("direct"))
    wanted = cut_lineage(node_pairs(t))
    links = t.edges().where(F.col("relation").isin("targets", "associated_with", "interacts_with")).select(F.col("source").alias("a"), F.col("target").alias("b"))
    out = P.shortest_paths(wanted, links, 4).join(known, ["source", "target"], "left")
    return out.select("source", "target", P.novelty_class(
        F.col("length"), F.element_at("path", 2), F.col("direct").isNotNull(), "Item", "Feature").alias("novelty"), "length")


view("adj_v", "SELECT source AS node, target AS neighbour FROM edges_v UNION SELECT target, source FROM edges_v")
view("deg_v", "SELECT node, count(*) AS degree, count(*) FILTER (starts_with(neighbour, 'Feature::')) AS features FROM adj_v GROUP BY 1")


@entry("g17_pair_topology", """
  WITH c AS (SELECT p.source, p.target, count(*) AS n, count(*) FILTER (starts_with(a.neighbour, 'Feature::')) AS nf,
               sum(CASE WHEN d.degree > 1 THEN 1 / ln(d.degree) ELSE 0 END) AS aa
             FROM pair_nodes_v p JOIN adj_v a ON a.node = p.source JOIN adj_v b ON b.node = p.target AND b.neighbour = a.neighbour
             JOIN deg_v d ON d.node = a.neighbour GROUP BY 1, 2)
  SELECT p.source, p.target, coalesce(x.degree, 0) AS degree_a, coalesce(y.degree, 0) AS degree_b, coalesce(c.n, 0) AS n_common,
    coalesce(c.nf, 0) AS n_common_features, CASE WHEN e.node IS NULL THEN 0 ELSE 1 END AS direct, coalesce(x.features, 0) AS features_a,
    coalesce(y.features, 0) AS features_b, round(coalesce(c.n, 0) / (coalesce(x.degree, 0) + coalesce(y.degree, 0) - coalesce(c.n, 0)), 6) AS jaccard,
    round(coalesce(c.aa, 0), 4) AS adamic_adar, round(ln(1 + coalesce(x.degree, 0)), 4) AS log_degree_a, round(ln(1 + coalesce(y.degree, 0)), 4) AS log_degree_b
  FROM pair_nodes_v p LEFT JOIN c USING (source, target) LEFT JOIN deg_v x ON x.node = p.source LEFT JOIN deg_v y ON y.node = p.target
  LEFT JOIN adj_v e ON e.node = p.source AND e.neighbour = p.target""")
def _(t):
    return G.pair_topology(node_pairs(t), t.edges(), "source", "target")


@entry("g18_context_profile", """
  SELECT node, kind, count(*) AS n, min(other) AS first, max(other) AS last FROM (
    SELECT DISTINCT node, CASE WHEN contains(lower(relation), 'treat') THEN 'treatments' ELSE split_part(other, '::', 1) END AS kind, other FROM (
      SELECT source AS node, target AS other, relation FROM edges_v UNION ALL SELECT target, source, relation FROM edges_v)
    WHERE starts_with(node, 'Context::')) GROUP BY 1, 2""")
def _(t):
    return G.profile(t.edges(), "Context")


@entry("g19_group_items", """
  SELECT grp, item, count(DISTINCT feature) AS features_hit FROM item_features_v JOIN feature_groups_v USING (feature) GROUP BY 1, 2""")
def _(t):
    return t.item_features().join(t.feature_groups(), "feature").groupBy("grp", "item").agg(F.countDistinct("feature").alias("features_hit"))


@entry("g19_feature_summary", """
  SELECT f.feature, f.grp, count(i.item) AS n_items, min(i.item) AS first_item FROM feature_groups_v f LEFT JOIN item_features_v i USING (feature) GROUP BY 1, 2""")
def _(t):
    return t.feature_groups().join(t.item_features(), "feature", "left").groupBy("feature", "grp").agg(
        F.count("item").alias("n_items"), F.min("item").alias("first_item"))


@entry("g20_coverage_ranking", """
  SELECT context, item, hits, round(hits / listed, 6) AS coverage, round(hits / size, 6) AS specificity, rank FROM (
    SELECT h.*, s.size, l.listed, row_number() OVER (PARTITION BY context ORDER BY hits DESC, size, item) AS rank FROM (
      SELECT c.context, i.item, count(*) AS hits FROM context_features_v c JOIN item_features_v i USING (feature) GROUP BY 1, 2) h
    JOIN (SELECT item, count(*) AS size FROM item_features_v GROUP BY 1) s USING (item)
    JOIN (SELECT context, count(*) AS listed FROM context_features_v GROUP BY 1) l USING (context)) WHERE rank <= 30""")
def _(t):
    return G.coverage_ranking(t.context_features(), t.item_features())


@entry("g21_adjacency_degree", "SELECT node, degree, features FROM deg_v")
def _(t):
    return G.adjacency(t.edges()).groupBy("node").agg(
        F.count("*").alias("degree"), F.count_if(F.startswith("neighbour", F.lit("Feature::"))).alias("features"))


view("numbered_v", "SELECT node, row_number() OVER (PARTITION BY node ORDER BY neighbour) - 1 AS number, neighbour FROM adj_v")
view("trail_v", """
  SELECT node AS start, walk, 0 AS step, node FROM deg_v, (SELECT unnest(range(1, 3)) AS walk)
  UNION ALL
  SELECT t.start, t.walk, t.step + 1, n.neighbour FROM trail_v t JOIN deg_v d ON d.node = t.node
  JOIN numbered_v n ON n.node = t.node AND n.number = (('0x' || substr(md5('42:' || t.start || ':' || t.walk || ':' || (t.step + 1)), 1, 8))::BIGINT % d.degree)
  WHERE t.step < 4""", recursive=True)


@entry("g18_context_neighbours", """
  SELECT DISTINCT node, CASE WHEN contains(lower(relation), 'treat') THEN 'treatments' ELSE split_part(other, '::', 1) END AS kind, other AS neighbour FROM (
    SELECT source AS node, target AS other, relation FROM edges_v UNION ALL SELECT target, source, relation FROM edges_v) WHERE starts_with(node, 'Context::')""")
def _(t):
    return G.profile_members(t.edges(), "Context")


@entry("g21_neighbours", "SELECT node, neighbour FROM adj_v")
def _(t):
    return G.adjacency(t.edges()).select("node", "neighbour")


@entry("g22_random_walks", "SELECT start, walk, step, node FROM trail_v")
def _(t):
    return G.random_walks(t.edges(), walks=2, steps=4)


view("long_trail_v", """
  SELECT node AS start, walk, 0 AS step, node FROM deg_v, (SELECT unnest(range(1, 11)) AS walk)
  UNION ALL
  SELECT t.start, t.walk, t.step + 1, n.neighbour FROM long_trail_v t JOIN deg_v d ON d.node = t.node
  JOIN numbered_v n ON n.node = t.node AND n.number = (('0x' || substr(md5('42:' || t.start || ':' || t.walk || ':' || (t.step + 1)), 1, 8))::BIGINT % d.degree)
  WHERE t.step < 80""", recursive=True)


def long_trail(t):
    """Ten walks of 80 steps from every node, written once for the queries that read them."""
    return t.keep("long_trail", lambda: G.random_walks(t.edges(), walks=10, steps=80, cut_every=10))


@entry("g22_walk_visits", "SELECT node, count(*) AS visits, count(DISTINCT start) AS starts, max(step) AS last_step FROM long_trail_v GROUP BY 1")
def _(t):
    return long_trail(t).groupBy("node").agg(F.count("*").alias("visits"), F.countDistinct("start").alias("starts"), F.max("step").alias("last_step"))


@entry("g23_neighbour_mean", """
  SELECT context, pos, round(avg(x), 6) AS value FROM (
    SELECT t.context, unnest(i.vec) AS x, unnest(range(0, 64)) AS pos FROM truth_v t JOIN item_vectors_v i USING (item)) GROUP BY 1, 2""")
def _(t):
    return G.neighbour_mean(t.truth(), t.item_vectors(), "context", "item")


@entry("g24_disconnected_contexts", """
  WITH lost AS (SELECT DISTINCT context FROM truth_v WHERE context NOT IN (SELECT context FROM vectors_v)),
       ends AS (SELECT source AS node, relation FROM edges_v UNION ALL SELECT target, relation FROM edges_v)
  SELECT l.context, count(e.relation) AS n_edges, count(*) FILTER (e.relation = 'treats') AS n_treats, count(DISTINCT e.relation) AS n_relations
  FROM lost l LEFT JOIN ends e ON e.node = 'Context::' || l.context GROUP BY 1""")
def _(t):
    return G.disconnected(t.truth(), t.vectors(), t.edges(), "context", F.concat(F.lit("Context::"), "context"))


view("resembles_v", """
  SELECT p.context, p.neighbour, p.similarity AS j_features,
    round(coalesce(s.n, 0) / (coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(s.n, 0)), 6) AS j_items,
    CASE WHEN x.nation = y.nation THEN 1 ELSE 0 END AS resembles
  FROM set_near_v p JOIN contexts_v x ON x.context = p.context JOIN contexts_v y ON y.context = p.neighbour
  LEFT JOIN (SELECT context, count(*) AS n FROM truth_v GROUP BY 1) a ON a.context = p.context
  LEFT JOIN (SELECT context, count(*) AS n FROM truth_v GROUP BY 1) b ON b.context = p.neighbour
  LEFT JOIN (SELECT n.context, n.neighbour, count(*) AS n FROM set_near_v n JOIN truth_v x ON x.context = n.context
             JOIN truth_v y ON y.context = n.neighbour AND x.item = y.item GROUP BY 1, 2) s ON s.context = p.context AND s.neighbour = p.neighbour""")


@entry("g25_edge_similarity", "SELECT context, neighbour, j_features, coalesce(j_items, 0) AS j_items, resembles FROM resembles_v")
def _(t):
    known = t.truth().select("context", F.col("item").alias("feature"))
    p = set_near(t).select("context", "neighbour", F.col("similarity").alias("j_features"))
    p = S.pair_jaccard(p, known, S.renamed_feature(known, "context", "neighbour"), "context", "neighbour", "j_items")
    n = t.contexts().select("context", "nation")
    m = n.select(F.col("context").alias("neighbour"), F.col("nation").alias("other"))
    return p.join(n, "context").join(m, "neighbour").select(
        "context", "neighbour", "j_features", "j_items", (F.col("nation") == F.col("other")).cast("int").alias("resembles"))
