"""S and C entries: file scans, sinks and cleansing."""

from pyspark.sql import functions as F

from loomgraph.catalog.base import entry, view
from loomgraph.catalog.similarity import top_items
from loomgraph.functions import text as T
from loomgraph.operators import cleanse as C
from loomgraph.session import new_path
from loomgraph.sources import readers as R
from loomgraph.sources import writers as W


def text_of(*cols, sep="\t"):
    return F.concat_ws(sep, *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]).alias("value")


def written_triples(t):
    path = new_path(t.spark, "triples")
    W.as_lines(t.edges().select(text_of("source", "relation", "target")), path)
    return R.triples(t.spark, path)


@entry("s1_triple_scan", "SELECT source AS head, relation, target AS tail FROM edges_v")
def _(t):
    return written_triples(t)


@entry("c1_nodes_from_edges", """
  SELECT type, count(*) AS n, min(id) AS first, max(name) AS last FROM (
    SELECT DISTINCT 'drkg:' || e AS id, e AS name, CASE WHEN contains(e, '::') THEN split_part(e, '::', 1) ELSE 'Unknown' END AS type
    FROM (SELECT source AS e FROM edges_v UNION SELECT target FROM edges_v)) GROUP BY 1""")
def _(t):
    return R.nodes_of_triples(written_triples(t)).groupBy("type").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("name").alias("last"))


@entry("c2_entity_prefix", """
  SELECT 'drkg:' || e AS id, CASE WHEN contains(e, '::') THEN split_part(e, '::', 1) ELSE 'Unknown' END AS type
  FROM (SELECT source AS e FROM edges_v UNION SELECT target FROM edges_v UNION SELECT c_name FROM customer)""")
def _(t):
    e = t.edges()
    ends = e.select(F.col("source").alias("e")).union(e.select("target")).union(t.raw("customer").select("c_name")).distinct()
    return ends.select(F.concat(F.lit("drkg:"), "e").alias("id"), R.typed_entity(F.col("e"))[0].alias("type"))


def written_documents(t):
    path = new_path(t.spark, "property")
    s = t.raw("supplier")
    node = F.struct(F.col("s_suppkey").cast("string").alias("identifier"), F.lit("Gene").alias("kind"), F.col("s_name").alias("name"),
                    F.create_map(F.lit("balance"), F.col("s_acctbal").cast("string")).alias("data"))
    edge = F.struct(F.array(F.lit("Gene"), F.col("s_suppkey").cast("string")).alias("source_id"),
                    F.array(F.lit("Pathway"), F.col("s_nationkey").cast("string")).alias("target_id"), F.lit("participates").alias("kind"),
                    F.lit("both").alias("direction"), F.create_map(F.lit("unbiased"), F.lit("true")).alias("data"))
    W.as_lines(s.select(F.to_json(F.struct(F.array(node).alias("nodes"), F.array(edge).alias("edges"))).alias("value")), path)
    return R.property_graph(t.spark, path, multi_line=False)


@entry("s2_property_graph_nodes", """
  SELECT 'hetionet:' || s_suppkey AS id, s_suppkey::VARCHAR AS original_id, 'Gene' AS type, s_name AS name, 'hetionet' AS source, s_acctbal AS balance FROM supplier""")
def _(t):
    nodes, _ = written_documents(t)
    return nodes.select("id", "original_id", "type", "name", "source", F.element_at("properties", "balance").cast("double").alias("balance"))


@entry("s2_property_graph_edges", """
  SELECT 'hetionet:' || s_suppkey AS source, 'participates' AS relation, 'hetionet:' || s_nationkey AS target, 'hetionet' AS source_kg FROM supplier""")
def _(t):
    return written_documents(t)[1].drop("properties")


@entry("s3_wide_edge_nodes", """
  SELECT 'primekg:' || type || ':' || id AS id, id AS original_id, type, name, src AS external_source, 'primekg' AS source FROM (
    SELECT DISTINCT i.item::VARCHAR AS id, 'drug' AS type, i.name AS name, 'part' AS src FROM item_features_v f JOIN items_v i USING (item)
    UNION SELECT DISTINCT s_suppkey::VARCHAR, 'gene/protein', s_name, 'supplier' FROM item_features_v f JOIN supplier ON s_suppkey = f.feature)""")
def _(t):
    path = new_path(t.spark, "wide")
    s = t.raw("supplier").select(F.col("s_suppkey").alias("feature"), "s_name")
    wide = t.item_features().join(t.items().select("item", "name"), "item").join(s, "feature").select(
        F.col("item").alias("x_id"), F.lit("drug").alias("x_type"), F.col("name").alias("x_name"), F.lit("part").alias("x_source"),
        F.lit("target").alias("relation"), F.col("feature").alias("y_id"), F.lit("gene/protein").alias("y_type"),
        F.col("s_name").alias("y_name"), F.lit("supplier").alias("y_source"), F.lit("target").alias("display_relation"))
    wide.write.option("header", True).csv(path)
    return R.nodes_of_wide(R.wide_edges(t.spark, path))


@entry("s4_graph_sink", """
  SELECT kind, name, count(*) AS n FROM (
    SELECT 'edge' AS kind, relation AS name FROM edges_v UNION ALL SELECT 'node', split_part(e, '::', 1)
    FROM (SELECT source AS e FROM edges_v UNION SELECT target FROM edges_v)) GROUP BY 1, 2""")
def _(t):
    path = new_path(t.spark, "graph")
    e = t.edges()
    W.graph_tables(R.nodes_of_triples(e.select(F.col("source").alias("head"), F.col("target").alias("tail"))), e, path)
    return t.spark.read.parquet(f"{path}/stats").select("kind", "name", "n")


@entry("s5_indication_scan", """
  SELECT c.name AS disease, i.name AS drug, count(*) AS n FROM truth_v JOIN contexts_v c USING (context) JOIN items_v i USING (item)
  WHERE c.balance > 0 GROUP BY 1, 2""")
def _(t):
    path = new_path(t.spark, "indications")
    c = t.contexts().select("context", F.when(F.col("balance") > 0, F.concat(F.lit(" "), "name")).otherwise(F.lit("  ")).alias("disease"))
    t.truth().join(c, "context").join(t.items().select("item", F.col("name").alias("drug")), "item").select("disease", "drug").write.option("header", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return R.indications(t.spark, path).na.drop(subset=["disease", "drug"]).groupBy("disease", "drug").agg(F.count("*").alias("n"))


@entry("s6_json_dictionary_scan", "SELECT item::VARCHAR AS item, feature::VARCHAR AS feature FROM item_features_v")
def _(t):
    path = new_path(t.spark, "dictionary")
    W.keyed_json(t.item_features(), "item", "feature", path)
    return R.json_map(t.spark, path, "item", "feature")


@entry("s6_nested_dictionary_scan", "SELECT n_name AS batch, c_name AS name, 'MESH:' || c_custkey AS id FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _(t):
    path = new_path(t.spark, "nested")
    c = t.raw("customer").join(t.raw("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    inner = F.create_map(F.col("c_name"), F.concat(F.lit("MESH:"), "c_custkey"))
    W.as_lines(c.select(F.to_json(F.create_map(F.col("n_name"), inner)).alias("value")), path)
    return R.nested_json_map(t.spark, path)


@entry("s7_embedding_scan", "SELECT 'drkg:' || context AS id, round(list_sum(vec), 6) AS total, round(vec[1], 6) AS first, len(vec) AS dims FROM vectors_v")
def _(t):
    path = new_path(t.spark, "vectors")
    v = t.vectors()
    v.select(F.col("context").alias("entity"), *[F.col("vec")[i].cast("double").alias(f"dim_{i}") for i in range(64)]).write.option("header", True).csv(path)
    from loomgraph.functions.vectors import total

    return R.embeddings_csv(t.spark, path, 64).select("id", F.round(total(F.col("vec")), 6).alias("total"), F.round(F.col("vec")[0], 6).alias("first"), F.size("vec").alias("dims"))


view("gene_lookup_v", "SELECT s_suppkey::VARCHAR AS key, s_name AS label, 'n' || s_nationkey AS kind FROM supplier WHERE s_acctbal >= 0")


def gene_lookup(t):
    path = new_path(t.spark, "genes")
    s = t.raw("supplier")
    symbol = F.when(F.col("s_acctbal") < 0, F.lit("-")).otherwise(F.col("s_name"))
    kind = F.concat(F.lit("n"), "s_nationkey")
    blank = F.lit("-")
    cols = [F.lit("9606"), F.col("s_suppkey"), symbol, *[blank] * 5, F.col("s_name"), kind, *[blank] * 6]
    W.as_lines(s.select(text_of(*cols)), path)
    return R.gene_info(t.spark, path)


@entry("s8_commented_tsv_scan", "SELECT key AS GeneID, label AS Symbol, kind AS type_of_gene FROM gene_lookup_v")
def _(t):
    return gene_lookup(t).select("GeneID", "Symbol", "type_of_gene")


@entry("c9_struct_lookup", "SELECT key AS id, label AS symbol, kind AS gene_type FROM gene_lookup_v")
def _(t):
    g = gene_lookup(t).select(F.col("GeneID").alias("id"), F.struct(F.col("Symbol").alias("symbol"), F.col("type_of_gene").alias("gene_type")).alias("info"))
    return g.select("id", "info.symbol", "info.gene_type")


@entry("s9_relation_counts", "SELECT relation, source_kg, count(*) AS n FROM edges_v GROUP BY 1, 2")
def _(t):
    return t.edges().groupBy("relation", "source_kg").agg(F.count("*").alias("n"))


view("side_effects_v", """
  SELECT DISTINCT lower(p_name) AS name, lower(n_name) AS term FROM lineitem JOIN part ON p_partkey = l_partkey
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey""")


def side_effects(t):
    names, effects = new_path(t.spark, "names"), new_path(t.spark, "effects")
    W.as_lines(t.raw("part").select(text_of("p_partkey", "p_name")), names)
    line = t.raw("lineitem").join(t.raw("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(t.raw("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    W.as_lines(line.select(text_of("l_partkey", "l_linenumber", "n_name")), effects)
    return R.side_effects(t.spark, names, effects)


@entry("s10_side_effect_scan", "SELECT * FROM side_effects_v")
def _(t):
    return side_effects(t)


def exported(t):
    return top_items(t).join(t.contexts().select("context", "title"), "context").select(
        F.col("title").alias("disease_name"), F.concat(F.lit("DB"), "item").alias("drug_id"), "score", F.col("rank").cast("int").alias("rank"))


@entry("s11_ranked_prediction_scan", "SELECT title AS disease_name, 'DB' || item AS drug_id, score, rank FROM top_v JOIN contexts_v USING (context)")
def _(t):
    path = new_path(t.spark, "ranked")
    exported(t).write.option("header", True).csv(path)
    return R.ranked_predictions(t.spark, path)


TIER_SQL = "CASE WHEN rank <= 5 THEN 'HIGH' WHEN rank <= 15 THEN 'MEDIUM' ELSE 'LOW' END"


def simple_tier(rank):
    return F.when(rank <= 5, "HIGH").when(rank <= 15, "MEDIUM").otherwise("LOW")


@entry("s12_deliverable_sink", f"SELECT title AS disease_name, 'DB' || item AS drug_id, score, rank, {TIER_SQL} AS tier FROM top_v JOIN contexts_v USING (context)")
def _(t):
    path = new_path(t.spark, "deliverable")
    W.deliverable(exported(t).withColumn("tier", simple_tier(F.col("rank"))), path, "json")
    return t.spark.read.schema("disease_name string, drug_id string, score double, rank int, tier string").json(path)


@entry("s13_materialised_truth", "SELECT context, item FROM truth_v")
def _(t):
    path = new_path(t.spark, "truth")
    t.truth().write.parquet(path)
    return t.spark.read.parquet(path)


@entry("s14_evidence_scan", """
  SELECT i.name AS drug, c.name AS disease, count(*) AS pubmed_total, CASE WHEN count(*) >= 3 THEN 'STRONG' ELSE 'WEAK' END AS evidence_level
  FROM truth_v JOIN contexts_v c USING (context) JOIN items_v i USING (item) GROUP BY 1, 2""")
def _(t):
    path = new_path(t.spark, "evidence")
    e = t.truth().join(t.contexts().select("context", F.col("name").alias("disease")), "context").join(
        t.items().select("item", F.col("name").alias("drug")), "item").groupBy("drug", "disease").agg(F.count("*").cast("int").alias("pubmed_total"))
    body = F.struct("pubmed_total", F.when(F.col("pubmed_total") >= 3, "STRONG").otherwise("WEAK").alias("evidence_level"))
    W.as_lines(e.select(F.to_json(F.create_map(F.concat_ws("|", "drug", "disease"), body)).alias("value")), path)
    return R.keyed_evidence(t.spark, path).select("drug", "disease", "pubmed_total", "evidence_level")


view("dense_v", """
  WITH p AS (SELECT DISTINCT least(source, target) AS u, greatest(source, target) AS v FROM edges_v WHERE source <> target),
       n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS number FROM (SELECT u AS node FROM p UNION SELECT v FROM p))
  SELECT x.number AS a, y.number AS b FROM p JOIN n x ON x.node = p.u JOIN n y ON y.node = p.v""")


@entry("c24_undirected_dense_edges", "SELECT * FROM dense_v")
def _(t):
    return C.undirected_dense(t.edges())


@entry("s15_edge_list_sink", "SELECT * FROM dense_v")
def _(t):
    path = new_path(t.spark, "edgelist")
    W.edge_list(C.undirected_dense(t.edges()), path)
    return t.spark.read.schema("a bigint, b bigint").option("sep", " ").csv(path)


# ---- cleansing ------------------------------------------------------------------------
TYPES = {"Compound": "Drug", "drug": "Drug", "Gene": "Gene", "gene/protein": "Gene"}
DB, DB_ONLY = r"DB\d+", r"^(Compound::|DB\d+)"
view("nodes_raw_v", """
  SELECT 'drkg:Compound::DB' || (10000 + item) AS id, 'Compound' AS type, 'Compound::DB' || (10000 + item) AS name, 'drkg' AS source FROM items_v
  UNION ALL SELECT 'hetionet:DB' || (10000 + item), 'Compound', name, 'hetionet' FROM items_v WHERE size > 10
  UNION ALL SELECT 'primekg:drug:DB' || (10000 + item), 'drug', upper(name) || ' ', 'primekg' FROM items_v
  UNION ALL SELECT 'drkg:Gene::' || s_suppkey, 'Gene', 'Gene::' || s_suppkey, 'drkg' FROM supplier
  UNION ALL SELECT 'hetionet:' || s_suppkey, 'Gene', s_name, 'hetionet' FROM supplier
  UNION ALL SELECT 'primekg:gene/protein:' || s_suppkey, 'gene/protein', s_name, 'primekg' FROM supplier
  UNION ALL SELECT 'gnbr:Disease::' || context, 'Disease', name, 'gnbr' FROM contexts_v""")
view("nodes_v", "SELECT id, CASE type WHEN 'Compound' THEN 'Drug' WHEN 'drug' THEN 'Drug' WHEN 'gene/protein' THEN 'Gene' ELSE type END AS type, name, source FROM nodes_raw_v")


def raw_nodes(t):
    i, s, c = t.items(), t.raw("supplier"), t.contexts()
    db = F.concat(F.lit("DB"), (F.lit(10000) + F.col("item")).cast("string"))

    def node(df, prefix, key, kind, name, src):
        return df.select(F.concat(F.lit(prefix), key.cast("string")).alias("id"), F.lit(kind).alias("type"), name.alias("name"), F.lit(src).alias("source"))

    g = F.col("s_suppkey")
    parts = [
        node(i, "drkg:Compound::", db, "Compound", F.concat(F.lit("Compound::"), db), "drkg"),
        node(i.where("size > 10"), "hetionet:", db, "Compound", F.col("name"), "hetionet"),
        node(i, "primekg:drug:", db, "drug", F.concat(F.upper("name"), F.lit(" ")), "primekg"),
        node(s, "drkg:Gene::", g, "Gene", F.concat(F.lit("Gene::"), g.cast("string")), "drkg"),
        node(s, "hetionet:", g, "Gene", F.col("s_name"), "hetionet"),
        node(s, "primekg:gene/protein:", g, "gene/protein", F.col("s_name"), "primekg"),
        node(c, "gnbr:Disease::", F.col("context"), "Disease", F.col("name"), "gnbr"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nodes(t):
    return C.normalized(raw_nodes(t), "type", TYPES)


@entry("c3_type_normalisation", "SELECT id, type, name, source FROM nodes_v")
def _(t):
    return nodes(t)


RELATIONS = {"treats": "TREATS", "targets": "BINDS", "interacts_with": "INTERACTS"}
REL_SQL = "CASE relation WHEN 'treats' THEN 'TREATS' WHEN 'targets' THEN 'BINDS' WHEN 'interacts_with' THEN 'INTERACTS' ELSE relation END"


@entry("c4_relation_normalisation", f"SELECT source, {REL_SQL} AS relation, target, source_kg, relation AS relation_original FROM edges_v")
def _(t):
    return C.normalized(t.edges(), "relation", RELATIONS, "relation_original")


@entry("c5_unmapped_values", """
  SELECT relation, count(*) AS n FROM edges_v WHERE relation NOT IN ('treats', 'targets', 'interacts_with') GROUP BY 1 ORDER BY n DESC, relation LIMIT 20""")
def _(t):
    return C.unmapped_values(t.edges(), "relation", RELATIONS)


view("drug_lookup_v", r"""
  SELECT key, arg_min(name, (o, id)) AS label FROM (
    SELECT regexp_extract(id, 'DB\d+', 0) AS key, name, id, CASE source WHEN 'hetionet' THEN 1 ELSE 2 END AS o FROM nodes_v
    WHERE type = 'Drug' AND source IN ('hetionet', 'primekg') AND NOT regexp_matches(name, '^(Compound::|DB\d+)')) WHERE key <> '' GROUP BY 1""")


def drug_lookup(t):
    return C.lookup_by_precedence(nodes(t), "Drug", DB, DB_ONLY, ["hetionet", "primekg"])


@entry("c8_lookup_by_precedence", "SELECT * FROM drug_lookup_v")
def _(t):
    return drug_lookup(t)


view("named_drugs_v", r"""
  SELECT n.id, n.type, CASE WHEN n.type = 'Drug' AND regexp_matches(n.name, '^(Compound::|DB\d+)') THEN coalesce(l.label, n.name) ELSE n.name END AS name,
    n.source, n.drugbank_id FROM (
      SELECT *, CASE WHEN type = 'Drug' THEN coalesce(nullif(regexp_extract(id, 'DB\d+', 0), ''),
        CASE WHEN regexp_matches(name, '^(Compound::|DB\d+)') THEN nullif(regexp_extract(name, 'DB\d+', 0), '') END) END AS drugbank_id FROM nodes_v) n
    LEFT JOIN drug_lookup_v l ON l.key = n.drugbank_id""")
view("named_v", r"""
  SELECT n.id, n.type, CASE WHEN n.type = 'Gene' AND regexp_matches(n.name, '^(Gene::)?\d+$') THEN coalesce(l.label, n.name) ELSE n.name END AS name,
    n.source, n.drugbank_id, n.ncbi_gene_id FROM (
      SELECT *, CASE WHEN type = 'Gene' THEN nullif(regexp_extract(id, '\d+$', 0), '') END AS ncbi_gene_id FROM named_drugs_v) n
    LEFT JOIN gene_lookup_v l ON l.key = n.ncbi_gene_id""")


def named_drugs(t):
    return C.resolve_names(nodes(t), drug_lookup(t), "Drug", DB, DB_ONLY, "drugbank_id")


def named(t):
    genes = gene_lookup(t).select(F.col("GeneID").alias("key"), F.col("Symbol").alias("label"))
    return C.resolve_names(named_drugs(t), genes, "Gene", r"\d+$", r"^(Gene::)?\d+$", "ncbi_gene_id")


@entry("c6_drug_name_resolution", "SELECT * FROM named_drugs_v")
def _(t):
    return named_drugs(t)


@entry("c7_gene_symbol_resolution", "SELECT * FROM named_v")
def _(t):
    return named(t)


@entry("c10_resolution_coverage", r"""
  SELECT type, count(*) AS total, count(*) FILTER (need) AS need, count(*) FILTER (need AND label IS NOT NULL) AS resolved,
    CASE WHEN count(*) FILTER (need) > 0 THEN round(count(*) FILTER (need AND label IS NOT NULL) * 100 / count(*) FILTER (need), 4) ELSE 0 END AS rate
  FROM (SELECT n.type, regexp_matches(n.name, '^(Compound::|DB\d+)') AS need, l.label FROM nodes_v n
        LEFT JOIN drug_lookup_v l ON l.key = regexp_extract(n.id || ' ' || n.name, 'DB\d+', 0)) GROUP BY 1""")
def _(t):
    return C.resolution_coverage(nodes(t), drug_lookup(t), DB, DB_ONLY)


@entry("c11_table_checks", """
  WITH m AS (SELECT (SELECT count(*) FROM named_v) AS n, (SELECT count(DISTINCT id) FROM named_v) AS ids, (SELECT count(*) FROM nodes_raw_v) AS old,
    (SELECT count(*) FROM named_v WHERE name IS NULL OR name = '') AS no_name,
    (SELECT count(*) FROM named_v WHERE type NOT IN ('Drug', 'Gene')) AS bad,
    (SELECT count(*) FROM named_v a JOIN nodes_raw_v b USING (id) WHERE a.name IS DISTINCT FROM b.name) AS renamed)
  SELECT unnest(['row_count_kept', 'id_unique', 'id_present', 'type_present', 'name_present', 'type_in_domain', 'name_unchanged']) AS check_name,
    unnest([abs(n - old), n - ids, 0, 0, no_name, bad, renamed]) AS offending,
    unnest([n = old, n = ids, true, true, no_name = 0, bad = 0, renamed = 0]) AS passed FROM m""")
def _(t):
    return C.table_checks(named(t), raw_nodes(t), ["Drug", "Gene"])


view("typed_nodes_v", "SELECT 'Item::' || item AS id, 'Item' AS type FROM items_v WHERE size > 3 UNION ALL SELECT 'Context::' || context, 'Context' FROM contexts_v UNION ALL SELECT 'Feature::' || s_suppkey, 'Feature' FROM supplier WHERE s_acctbal > 500")


@entry("c12_orphan_edges", """
  WITH m AS (SELECT source NOT IN (SELECT id FROM typed_nodes_v) AS s, target NOT IN (SELECT id FROM typed_nodes_v) AS d FROM edges_v)
  SELECT count(*) FILTER (s) AS no_source, count(*) FILTER (d) AS no_target, count(*) FILTER (s AND d) AS no_end,
    count(*) FILTER (s) + count(*) FILTER (d) AS total, count(*) FILTER (s OR d) AS edges FROM m""")
def _(t):
    n = t.items().where("size > 3").select(F.concat(F.lit("Item::"), "item").alias("id")).unionByName(
        t.contexts().select(F.concat(F.lit("Context::"), "context").alias("id"))).unionByName(
        t.raw("supplier").where("s_acctbal > 500").select(F.concat(F.lit("Feature::"), "s_suppkey").alias("id")))
    return C.orphan_edges(t.edges(), n)


STATS_SQL = """
  SELECT 'node_type' AS metric, type AS value, count(*) AS n, round(count(name) * 100 / count(*), 4) AS pct_named FROM nodes_v GROUP BY 2
  UNION ALL SELECT 'node_source', source, count(*), round(count(name) * 100 / count(*), 4) FROM nodes_v GROUP BY 2
  UNION ALL SELECT 'nodes', 'all', count(*), round(count(name) * 100 / count(*), 4) FROM nodes_v
  UNION ALL SELECT 'relation', relation, count(*), NULL FROM edges_v GROUP BY 2
  UNION ALL SELECT 'edge_source', source_kg, count(*), NULL FROM edges_v GROUP BY 2
  UNION ALL SELECT 'edges', 'all', count(*), NULL FROM edges_v"""


@entry("c13_graph_statistics", STATS_SQL)
def _(t):
    return C.graph_statistics(nodes(t), t.edges())


@entry("c14_name_quality", r"""
  SELECT pattern, count(*) AS n, string_agg(DISTINCT CASE WHEN r <= 5 THEN name END, ',' ORDER BY CASE WHEN r <= 5 THEN name END) AS samples FROM (
    SELECT pattern, name, dense_rank() OVER (PARTITION BY pattern ORDER BY name) AS r FROM (
      SELECT name, unnest([CASE WHEN regexp_matches(name, '^Gene::\d+$') THEN 'gene_id_only' END, CASE WHEN regexp_matches(name, '^Compound::DB\d+$') THEN 'compound_drugbank' END]) AS pattern
      FROM nodes_v) WHERE pattern IS NOT NULL) GROUP BY 1""")
def _(t):
    return C.name_quality(nodes(t), {"gene_id_only": r"^Gene::\d+$", "compound_drugbank": r"^Compound::DB\d+$"})


@entry("c15_relation_families", """
  SELECT family, count(*) AS n_relations, sum(n) AS n_edges FROM (
    SELECT relation, CASE WHEN split_part(lower(relation), '::', 1) IN ('hetionet', 'drugbank', 'string', 'intact', 'gnbr', 'bioarx') THEN split_part(lower(relation), '::', 1) ELSE 'other' END AS family, count(*) AS n
    FROM (SELECT CASE relation WHEN 'treats' THEN 'GNBR::T::Compound:Disease' WHEN 'targets' THEN 'DRUGBANK::target::Compound:Gene' WHEN 'associated_with' THEN 'GNBR::L::Gene:Disease' ELSE relation END AS relation FROM edges_v) GROUP BY 1) GROUP BY 1""")
def _(t):
    names = {"treats": "GNBR::T::Compound:Disease", "targets": "DRUGBANK::target::Compound:Gene", "associated_with": "GNBR::L::Gene:Disease"}
    return C.relation_families(C.normalized(t.edges(), "relation", names))


@entry("c16_before_after_report", """
  SELECT coalesce(b.type, a.type) AS type, coalesce(b.n, 0) AS old, coalesce(a.n, 0) AS new, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta,
    CASE WHEN coalesce(b.n, 0) > 0 THEN round((coalesce(a.n, 0) - b.n) * 100 / b.n, 4) END AS pct
  FROM (SELECT type, count(*) AS n FROM nodes_raw_v GROUP BY 1) b FULL JOIN (SELECT type, count(*) AS n FROM nodes_v GROUP BY 1) a ON a.type = b.type""")
def _(t):
    count = lambda df: df.groupBy("type").agg(F.count("*").alias("n"))
    return C.before_after(count(raw_nodes(t)), count(nodes(t)), ["type"])


BASE_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract(id, '{p}', 1), '')" for p in T.BASE_ID_PATTERNS) + ")"
view("by_name_v", f"""
  SELECT key, id, source, {BASE_SQL} AS base FROM (SELECT *, type || '::' || lower(trim(name)) AS key, count(*) OVER (PARTITION BY type || '::' || lower(trim(name))) AS c FROM named_v) WHERE c > 1""")
view("by_id_v", f"""
  SELECT key, id, source, {BASE_SQL} AS base FROM (SELECT *, count(*) OVER (PARTITION BY key) AS c FROM (
    SELECT *, CASE WHEN type = 'Drug' THEN 'DrugBank::' || drugbank_id WHEN type = 'Gene' THEN 'NCBI::' || ncbi_gene_id END AS key FROM named_v WHERE size_ok)
    WHERE key IS NOT NULL) WHERE c > 1""".replace("WHERE size_ok", ""))
CONF_SQL = """round(CASE WHEN count(DISTINCT source) > 1 THEN least(CASE WHEN count(DISTINCT base) = 1 THEN 0.95 WHEN count(DISTINCT base) > 1 THEN 0.80 ELSE 0.60 END + 0.05, 0.99)
  ELSE CASE WHEN count(DISTINCT base) = 1 THEN 0.95 WHEN count(DISTINCT base) > 1 THEN 0.80 ELSE 0.60 END END, 2)::DOUBLE"""
GROUP_SQL = f"SELECT key, count(*) AS n, {CONF_SQL} AS confidence, min(id) AS first_id, max(id) AS last_id"


def by_name(t):
    return t.keep("by_name", lambda: C.keyed_members(t.keep("named", lambda: named(t)), C.name_key()))


def by_id(t):
    key = F.when(F.col("type") == "Drug", F.concat(F.lit("DrugBank::"), "drugbank_id")).when(F.col("type") == "Gene", F.concat(F.lit("NCBI::"), "ncbi_gene_id"))
    return t.keep("by_id", lambda: C.keyed_members(t.keep("named", lambda: named(t)), key))


@entry("c17_duplicates_by_name", f"{GROUP_SQL} FROM by_name_v GROUP BY 1")
def _(t):
    return C.duplicate_groups(by_name(t)).drop("x", "s")


@entry("c18_duplicates_by_external_id", f"{GROUP_SQL} FROM by_id_v GROUP BY 1")
def _(t):
    return C.duplicate_groups(by_id(t)).drop("x", "s")


def members_sql(view_name):
    return f"SELECT m.key, m.id, m.source, m.base, g.n, g.confidence FROM {view_name} m JOIN ({GROUP_SQL} FROM {view_name} GROUP BY 1) g ON g.key = m.key"


@entry("c17_duplicate_members_by_name", members_sql("by_name_v"))
def _(t):
    return C.group_members(by_name(t))


@entry("c18_duplicate_members_by_external_id", members_sql("by_id_v"))
def _(t):
    return C.group_members(by_id(t))


@entry("c19_base_id", f"SELECT id, {BASE_SQL} AS base FROM nodes_v")
def _(t):
    return nodes(t).select("id", T.base_id(F.col("id")).alias("base"))


@entry("c20_duplicate_confidence", f"SELECT confidence, count(*) AS n_groups, sum(n) AS n_members FROM ({GROUP_SQL} FROM by_name_v GROUP BY 1) GROUP BY 1")
def _(t):
    return C.duplicate_groups(by_name(t)).groupBy("confidence").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_members"))


@entry("c21_merged_duplicates", f"""
  SELECT arg_min(key, key) AS key, confidence, first_id, last_id, n, 'external_id' AS match_type FROM (
    {GROUP_SQL}, string_agg(id, '|' ORDER BY id) AS members FROM by_id_v GROUP BY 1) GROUP BY members, n, confidence, first_id, last_id
  UNION ALL
  {GROUP_SQL.replace('SELECT key, count(*) AS n,', 'SELECT key,')}, count(*) AS n, 'name' FROM by_name_v
  WHERE key NOT IN (SELECT key FROM by_name_v WHERE id IN (SELECT id FROM by_id_v)) GROUP BY 1""")
def _(t):
    return C.merged_duplicates(by_name(t), by_id(t))


@entry("c22_first_per_key", """
  SELECT conv_id, role, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM conversations) WHERE r = 1""")
def _(t):
    return C.first_per_key(t.raw("conversations"), ["conv_id", "role"], "turn")


@entry("c23_edge_type_exclusion", """
  SELECT relation, count(*) FILTER (relation IN ('treats', 'palliates')) AS removed, count(*) FILTER (relation NOT IN ('treats', 'palliates')) AS kept FROM edges_v GROUP BY 1""")
def _(t):
    return C.exclusion_report(t.edges(), ["treats", "palliates"])


view("named_truth_v", "SELECT t.context, t.item, c.name AS context_name, i.name AS item_name FROM truth_v t JOIN contexts_v c USING (context) JOIN items_v i USING (item)")
view("false_pairs_v", "SELECT DISTINCT i.name AS item_name, c.name AS context_name FROM truth_extra_v t JOIN contexts_v c USING (context) JOIN items_v i USING (item) WHERE i.size = 50")


def named_truth(t):
    return t.truth().join(t.contexts().select("context", F.col("name").alias("context_name")), "context").join(
        t.items().select("item", F.col("name").alias("item_name")), "item")


def false_pairs(t):
    i = t.items().where("size = 50").select("item", F.col("name").alias("item_name"))
    return t.truth("A").join(i, "item").join(t.contexts().select("context", F.col("name").alias("context_name")), "context").select("item_name", "context_name").distinct()


@entry("c25_false_pair_removal", """
  SELECT context, item FROM named_truth_v n WHERE item_name NOT IN ('old anvil', 'cold rod') AND NOT (item_name = 'red plate' AND contains(context_name, 'furniture'))
  AND NOT EXISTS (SELECT 1 FROM false_pairs_v f WHERE f.item_name = n.item_name AND f.context_name = n.context_name)""")
def _(t):
    return C.without_false_pairs(named_truth(t), false_pairs(t), ["Old Anvil", "Cold Rod"], {"red plate": "Furniture"}).select("context", "item")


@entry("c26_allow_list_removal", """
  SELECT context, item FROM named_truth_v WHERE (item_name <> 'hot bolt' OR regexp_matches(context_name, '(building|machinery)')) AND (item_name <> 'new gear' OR contains(context_name, 'nation_1'))""")
def _(t):
    return C.allowed_only(named_truth(t), {"hot bolt": ["building", "machinery"], "new gear": ["nation_1"]}).select("context", "item")


@entry("c27_vector_quality", """
  SELECT label, count(*) AS n, 0 AS n_nan, 0 AS n_inf, count(*) FILTER (norm < 1e-10) AS n_zero, 0 AS n_huge, round(min(norm), 6) AS min_norm, round(max(norm), 6) AS max_norm,
    round(avg(norm), 6) AS mean_norm, round(stddev_pop(norm), 6) AS std_norm FROM (SELECT label, sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS norm FROM vectors_v) GROUP BY 1""")
def _(t):
    return C.vector_quality(t.vectors(), "label")


@entry("c28_spot_check", "SELECT id, type, name, source FROM nodes_v ORDER BY md5(id), id LIMIT 50")
def _(t):
    return C.spot_check(nodes(t), "id")


@entry("c29_truth_enrichment", "SELECT context, item FROM truth_v UNION SELECT context, item FROM truth_extra_v")
def _(t):
    return t.truth().unionByName(t.truth("A")).distinct()
