"""N entries: name functions and entity matching."""

from pyspark.sql import functions as F

from loomgraph.catalog.base import entry, view
from loomgraph.catalog.ingest import side_effects
from loomgraph.catalog.similarity import top_items
from loomgraph.functions import text as T
from loomgraph.operators import names as N

SYNONYMS = {"joinery": "furniture nation 1", "car trade": "automobile nation 3", "home goods": "household nation 2", "engines": "machinery nation 6"}
NORM = "regexp_replace(regexp_replace(regexp_replace(replace(replace(trim(lower({0})), '''s', 's'), '''', ''), '[-_]', ' ', 'g'), '\\s+', ' ', 'g'), '[.,;:]+$', '')"

view("noisy_v", """
  SELECT c_custkey AS id, CASE n_regionkey WHEN 0 THEN ' ' || c_mktsegment || '-' || n_name || '''s.,' WHEN 1 THEN 'Joinery' WHEN 2 THEN 'severe relapsing ' || c_mktsegment || '  ' || n_name || ' of the east;'
    WHEN 3 THEN 'overseas car trade ' || n_name ELSE c_name END AS name
  FROM customer JOIN nation ON n_nationkey = c_nationkey""")


def noisy(t):
    n = t.raw("nation")
    c = t.raw("customer").join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    seg, nat = F.col("c_mktsegment"), F.col("n_name")
    return c.select(F.col("c_custkey").alias("id"), F.when(F.col("n_regionkey") == 0, F.concat(F.lit(" "), seg, F.lit("-"), nat, F.lit("'s.,")))
                    .when(F.col("n_regionkey") == 1, "Joinery").when(F.col("n_regionkey") == 2, F.concat(F.lit("severe relapsing "), seg, F.lit("  "), nat, F.lit(" of the east;")))
                    .when(F.col("n_regionkey") == 3, F.concat(F.lit("overseas car trade "), nat)).otherwise(F.col("c_name")).alias("name"))


@entry("n1_normal_name", f"SELECT id, {NORM.format('name')} AS norm FROM noisy_v")
def _(t):
    return noisy(t).select("id", T.normal_context_name(F.col("name")).alias("norm"))


view("salted_v", "SELECT DISTINCT p_name || CASE WHEN p_size % 3 = 0 THEN ' hydrochloride' WHEN p_size % 3 = 1 THEN ' sodium (' || p_type || ')' ELSE '' END AS name FROM part")


def salted(t):
    size = F.col("p_size") % 3
    return t.raw("part").select(F.concat("p_name", F.when(size == 0, F.lit(" hydrochloride")).when(size == 1, F.concat(F.lit(" sodium ("), "p_type", F.lit(")"))).otherwise(F.lit(""))).alias("name")).distinct()


@entry("n2_salt_fallback", """
  SELECT s.name, arg_min(k.id, (o, k.id)) AS id FROM (
    SELECT name, unnest([0, 1, 2, 3, 4]) AS o, unnest([name, replace(name, ' hydrochloride', ''), replace(replace(name, ' hydrochloride', ''), ' hcl', ''),
      replace(replace(replace(name, ' hydrochloride', ''), ' hcl', ''), ' sodium', ''), replace(replace(replace(name, ' hydrochloride', ''), ' hcl', ''), ' sodium', '')]) AS form
    FROM (SELECT DISTINCT lower(name) AS name FROM salted_v)) f JOIN (SELECT lower(name) AS n, min(item) AS id FROM items_v GROUP BY 1) k ON k.n = trim(f.form)
  RIGHT JOIN (SELECT DISTINCT lower(name) AS name FROM salted_v) s ON s.name = f.name GROUP BY 1""")
def _(t):
    known = t.items().groupBy("name").agg(F.min("item").alias("id"))
    return N.salt_fallback(salted(t).select(F.lower("name").alias("name")), known, [" hydrochloride", " hcl", " sodium"])


SALTED = "lower(trim(name))"
for _s in T.SALT_WORDS:
    SALTED = f"replace({SALTED}, '{_s}', '')"


@entry("n3_item_name_normaliser", f"SELECT name, regexp_replace(regexp_replace({SALTED}, '\\([^)]*\\)', '', 'g'), '[^a-z0-9]', '', 'g') AS norm FROM salted_v")
def _(t):
    return salted(t).select("name", T.normal_item_name(F.col("name")).alias("norm"))


SYN_SQL = "(VALUES " + ", ".join(f"({i}, '{s}', '{c}')" for i, (s, c) in enumerate(SYNONYMS.items())) + ") AS y(o, s, c)"


def canon_sql(col):
    return f"""coalesce((SELECT c FROM {SYN_SQL} WHERE y.s = {col} LIMIT 1),
      (SELECT arg_min(c, o) FROM {SYN_SQL} WHERE length(y.s) >= 6 AND (contains({col}, y.s) OR (length({col}) >= 6 AND contains(y.s, {col})))), {col})"""


view("noisy_norm_v", f"SELECT DISTINCT name, {NORM.format('name')} AS norm FROM noisy_v")
view("noisy_canon_v", f"SELECT name, norm, {canon_sql('norm')} AS canon FROM noisy_norm_v")


@entry("n5_synonym_canonicaliser", "SELECT name, norm, canon FROM noisy_canon_v")
def _(t):
    n = noisy(t).select("name").distinct().withColumn("norm", T.normal_context_name(F.col("name")))
    return n.join(N.canonical(n, "norm", N.synonym_table(n.sparkSession, SYNONYMS)), "norm", "left").select("name", "norm", "canon")


view("mapped_v", f"SELECT m_norm, min(id) AS id FROM (SELECT {NORM.format('name')} AS m_norm, 'M' || context AS id FROM contexts_v) GROUP BY 1")
view("mapped_canon_v", f"SELECT m_canon, min(id) AS id FROM (SELECT {canon_sql('m_norm')} AS m_canon, id FROM mapped_v) GROUP BY 1")
view("matched_v", """
  SELECT n.name, coalesce(a.id, b.id, d.id) AS id, CASE WHEN a.id IS NOT NULL THEN 1 WHEN b.id IS NOT NULL THEN 2 WHEN d.id IS NOT NULL THEN 4 END AS step
  FROM noisy_canon_v n LEFT JOIN mapped_v a ON a.m_norm = n.norm LEFT JOIN mapped_canon_v b ON b.m_canon = n.canon
  LEFT JOIN (SELECT x.norm, min(m.m_norm) AS m_norm FROM noisy_canon_v x JOIN mapped_v m ON length(x.norm) > 20 AND length(m.m_norm) > 10
      AND (contains(x.norm, m.m_norm) OR contains(m.m_norm, x.norm)) GROUP BY 1) s ON s.norm = n.norm
  LEFT JOIN mapped_v d ON d.m_norm = s.m_norm""")


def matched(t):
    m = t.contexts().select("name", F.concat(F.lit("M"), "context").alias("id"))
    return N.cascade_match(noisy(t), m, SYNONYMS)


@entry("n4_cascade_match", "SELECT * FROM matched_v")
def _(t):
    return matched(t)


@entry("n6_partial_search", """
  SELECT word, item, name, place FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY name, item) AS place FROM (
    SELECT w.word, i.item, i.name FROM items_v i, (SELECT unnest(['ring', 'hot b', 'a very cold rod indeed']) AS word) w WHERE contains(lower(i.name), w.word) OR contains(w.word, lower(i.name)))) WHERE place <= 10""")
def _(t):
    return N.search(t.items(), "name", "item", ["ring", "Hot B", "a very cold rod indeed"], 10)


@entry("n7_mapping_coverage", """
  SELECT count(*) AS total, count(id) AS mapped, count(*) - count(id) AS unmapped, round(count(id) / count(*), 6) AS rate,
    (SELECT string_agg(name, '|' ORDER BY name) FROM (SELECT name FROM matched_v WHERE id IS NULL ORDER BY name LIMIT 50)) AS unmapped_names FROM matched_v""")
def _(t):
    return N.coverage(matched(t))


@entry("n8_mention_resolution", """
  WITH m AS (SELECT category AS mention, lower(category) AS low FROM contexts_v UNION SELECT name || ' trade', lower(name || ' trade') FROM contexts_v UNION SELECT title, lower(title) FROM contexts_v UNION SELECT name, lower(name) FROM contexts_v),
    e AS (SELECT lower(name) AS low, min(context) AS id FROM contexts_v GROUP BY 1)
  SELECT m.mention, coalesce(e.id, e2.id) AS id, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN e2.id IS NOT NULL THEN 'partial' ELSE 'none' END AS how
  FROM m LEFT JOIN e ON e.low = m.low
  LEFT JOIN (SELECT m.low, min(e.low) AS e2 FROM m JOIN e ON contains(m.low, e.low) OR contains(e.low, m.low) GROUP BY 1) p ON p.low = m.low
  LEFT JOIN e e2 ON e2.low = p.e2""")
def _(t):
    c = t.contexts()
    m = c.select(F.col("category").alias("mention")).union(c.select(F.concat("name", F.lit(" trade")))).union(c.select("title")).union(c.select("name"))
    return N.resolve_mentions(m, c.select("name", F.col("context").alias("id")))


@entry("n9_plain_ids", r"""
  SELECT id, regexp_replace(regexp_replace(id, '^drkg:', ''), '^(Compound::|Disease::|Gene::)(MESH:|DOID:)?', '') AS plain FROM (
    SELECT id FROM nodes_v UNION ALL SELECT 'drkg:Disease::MESH:D' || context FROM contexts_v)""")
def _(t):
    from loomgraph.catalog.ingest import nodes

    ids = nodes(t).select("id").union(t.contexts().select(F.concat(F.lit("drkg:Disease::MESH:D"), "context")))
    return ids.select("id", T.plain_id(F.col("id")).alias("plain"))


def sig_sql(c):
    stop = ", ".join(f"'{w}'" for w in T.LOOSE_STOP_WORDS)
    return f"list_filter(list_distinct(regexp_split_to_array(lower({c}), '\\s+')), lambda w: w <> '' AND NOT list_contains([{stop}], w))"


view("terms_v", "SELECT DISTINCT name AS a, term AS b FROM (SELECT DISTINCT category || ' disorder of type ' || split_part(name, ' ', 2) AS name FROM contexts_v), (SELECT DISTINCT n_name AS term FROM nation UNION SELECT DISTINCT c_mktsegment || ' condition' FROM customer)")
LOOSE = f"""(lower(a) = lower(b) OR (length(b) >= 5 AND contains(lower(a), lower(b))) OR (length(a) >= 5 AND contains(lower(b), lower(a)))
  OR (len({sig_sql('a')}) > 0 AND len({sig_sql('b')}) > 0 AND len(list_intersect({sig_sql('a')}, {sig_sql('b')})) > 0
      AND len(list_intersect({sig_sql('a')}, {sig_sql('b')})) >= least(len({sig_sql('a')}), len({sig_sql('b')}))))"""


def terms(t):
    c = t.contexts().select(F.concat("category", F.lit(" disorder of type "), F.split_part("name", F.lit(" "), F.lit(2))).alias("a")).distinct()
    b = t.raw("nation").select(F.col("n_name").alias("b")).union(t.raw("customer").select(F.concat("c_mktsegment", F.lit(" condition")))).distinct()
    return N.term_pairs(c, b)


@entry("n10_loose_term_match", f"SELECT a, b FROM terms_v WHERE {LOOSE}")
def _(t):
    p = terms(t)
    return p.where(T.loose_match(F.col("a"), F.col("b"))).select("a", "b")


def strict_sql(a, b):
    pa, pb = (f"' ' || regexp_replace(lower({x}), '[^a-z0-9_]+', ' ', 'g') || ' '" for x in (a, b))
    return f"(lower({a}) = lower({b}) OR (length({b}) >= 8 AND contains({pa}, {pb})) OR (length({a}) >= 8 AND contains({pb}, {pa})))"


@entry("n11_strict_phrase_match", f"SELECT a, b FROM terms_v WHERE {strict_sql('a', 'b')} AND lower(b) NOT IN ('nation_3', 'building condition')")
def _(t):
    return terms(t).where(T.strict_match(F.col("a"), F.col("b"), ["nation_3", "building condition"])).select("a", "b")


@entry("n12_name_aliases", """
  WITH k AS (SELECT lower(name) AS name, min(item) AS id FROM items_v GROUP BY 1), a(alias, official) AS (VALUES ('crimson plate', 'red plate'), ('hot bolt', 'cold bolt'), ('x', 'no such name'))
  SELECT name, id FROM k UNION ALL SELECT a.alias, k.id FROM a JOIN k ON k.name = a.official WHERE a.alias NOT IN (SELECT name FROM k)""")
def _(t):
    return N.with_aliases(t.items().select("name", F.col("item").alias("id")), {"crimson plate": "red plate", "hot bolt": "cold bolt", "x": "no such name"})


@entry("n13_proper_names", r"SELECT id, name FROM nodes_v WHERE NOT regexp_matches(lower(name), 'db\d+') AND NOT regexp_matches(lower(name), '^gene::') AND regexp_matches(name, '[a-zA-Z]') AND length(name) <= 18")
def _(t):
    from loomgraph.catalog.ingest import nodes

    return nodes(t).where(N.proper_name(F.col("name"), [r"DB\d+", "^gene::"], 18)).select("id", "name")


@entry("n14_rank_text", "SELECT context, min(rank) AS best, median(rank) AS median_rank FROM top_v JOIN truth_v USING (context, item) GROUP BY 1")
def _(t):
    hit = top_items(t).join(t.truth(), ["context", "item"])
    text = hit.groupBy("context").agg(F.concat(F.lit("{"), F.concat_ws(", ", F.collect_list(F.format_string("'%d': %d", "item", "rank"))), F.lit("}")).alias("txt"))
    best, median = N.rank_text(F.col("txt"))
    return text.select("context", best.alias("best"), median.alias("median_rank"))


@entry("n15_symbols_to_ids", """
  SELECT DISTINCT upper(s.s_name) AS symbol, s.s_suppkey AS feature FROM supplier s WHERE s_acctbal >= 0""")
def _(t):
    listed = t.raw("supplier").select(F.lower("s_name").alias("symbol"))
    lookup = t.raw("supplier").where("s_acctbal >= 0").select(F.upper("s_name").alias("symbol"), F.col("s_suppkey").alias("feature"))
    return N.symbols_to_ids(listed, lookup)


@entry("n16_find_by_alternatives", """
  SELECT query, id, name, matched FROM (
    SELECT q.query, c.id, c.low AS name, q.alt AS matched, row_number() OVER (PARTITION BY q.query ORDER BY q.o, c.low <> q.alt, c.low) AS r FROM (
      SELECT title AS query, unnest([title, name || ' district', name, category]) AS alt, unnest([0, 1, 2, 3]) AS o FROM (SELECT lower(title) AS title, lower(name) AS name, lower(category) AS category FROM contexts_v)) q
    JOIN (SELECT lower(name) AS low, min(context) AS id FROM contexts_v GROUP BY 1) c ON contains(c.low, q.alt)) WHERE r = 1""")
def _(t):
    c = t.contexts()
    q = c.select(F.lower("title").alias("query"), F.array("title", F.concat("name", F.lit(" district")), "name", "category").alias("alternatives"))
    return N.find_by_alternatives(q, c.select(F.col("context").alias("id"), "name"))
