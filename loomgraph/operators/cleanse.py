"""C: cleansing of node and edge tables, duplicate search and quality reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.functions import vectors as V

# Relation prefixes that form a family of their own.
RELATION_FAMILIES = ("hetionet", "drugbank", "string", "intact", "gnbr", "bioarx")


def literal_map(mapping: Mapping[str, str], c: Column) -> Column:
    """Lookup in a literal map of fixed size."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.element_at(F.create_map(*pairs), c)


def normalized(df: DataFrame, column: str, mapping: Mapping[str, str], keep_original: str | None = None) -> DataFrame:
    """Canonical value by map, unmapped values kept; the old value can stay in its own column."""
    if keep_original:
        df = df.withColumn(keep_original, F.col(column))
    return df.withColumn(column, F.coalesce(literal_map(mapping, F.col(column)), F.col(column)))


def unmapped_values(df: DataFrame, column: str, mapping: Mapping[str, str], n: int = 20) -> DataFrame:
    """Most frequent values without a mapping."""
    return (
        df.where(literal_map(mapping, F.col(column)).isNull()).groupBy(column).agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), column).limit(n)
    )


def resolve_names(nodes: DataFrame, lookup: DataFrame, node_type: str, id_pattern: str, id_only: str, id_column: str) -> DataFrame:
    """Names that are only ids are replaced from the lookup (key, label).

    The key comes from the node id, else from the name, and stays in its own column.
    """
    own = F.nullif(F.regexp_extract("id", id_pattern, 0), F.lit(""))
    needs = F.col("name").rlike(id_only)
    key = F.when(needs, F.coalesce(own, F.nullif(F.regexp_extract("name", id_pattern, 0), F.lit("")))).otherwise(own)
    keyed = nodes.withColumn(id_column, F.when(F.col("type") == node_type, key))
    out = keyed.join(lookup.select(F.col("key").alias(id_column), "label"), id_column, "left")
    return out.withColumn("name", F.when((F.col("type") == node_type) & needs, F.coalesce("label", "name")).otherwise(F.col("name"))).drop("label")


def lookup_by_precedence(nodes: DataFrame, node_type: str, id_pattern: str, id_only: str, sources: Sequence[str]) -> DataFrame:
    """First proper name per external id, sources in order of precedence."""
    order = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source"))
    return (
        nodes.where((F.col("type") == node_type) & F.col("source").isin(*sources) & ~F.col("name").rlike(id_only))
        .withColumn("key", F.regexp_extract("id", id_pattern, 0)).where(F.col("key") != "")
        .groupBy("key").agg(F.min_by("name", F.struct(order.alias("o"), F.col("id"))).alias("label"))
    )


def resolution_coverage(nodes: DataFrame, lookup: DataFrame, id_pattern: str, id_only: str) -> DataFrame:
    """Names that need resolution, those the lookup resolves, and the rate, per type."""
    key = F.regexp_extract(F.concat_ws(" ", "id", "name"), id_pattern, 0)
    df = nodes.withColumn("key", key).join(lookup.select("key", "label"), "key", "left")
    needs = F.col("name").rlike(id_only)
    return df.groupBy("type").agg(
        F.count("*").alias("total"), F.count_if(needs).alias("need"), F.count_if(needs & F.col("label").isNotNull()).alias("resolved")
    ).withColumn("rate", F.when(F.col("need") > 0, F.round(F.col("resolved") * 100 / F.col("need"), 4)).otherwise(0.0))


def table_checks(nodes: DataFrame, before: DataFrame, allowed_types: Sequence[str]) -> DataFrame:
    """C11: one row per check with the number of offending rows."""
    missing = lambda c: F.col(c).isNull() | (F.col(c) == "")
    one = nodes.agg(
        F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.count_if(missing("id")).alias("no_id"),
        F.count_if(missing("type")).alias("no_type"), F.count_if(missing("name")).alias("no_name"),
        F.count_if(~F.col("type").isin(*allowed_types)).alias("bad_type"),
    )
    old = before.agg(F.count("*").alias("old_rows"))
    renamed = nodes.select("id", F.col("name").alias("n1")).join(before.select("id", F.col("name").alias("n0")), "id").agg(
        F.count_if(~F.col("n1").eqNullSafe(F.col("n0"))).alias("renamed")
    )
    row = one.join(F.broadcast(old)).join(F.broadcast(renamed))
    checks = [
        ("row_count_kept", F.abs(F.col("rows") - F.col("old_rows"))), ("id_unique", F.col("rows") - F.col("ids")),
        ("id_present", F.col("no_id")), ("type_present", F.col("no_type")), ("name_present", F.col("no_name")),
        ("type_in_domain", F.col("bad_type")), ("name_unchanged", F.col("renamed")),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), c.cast("bigint").alias("offending")) for n, c in checks])
    return row.select(F.explode(rows).alias("c")).select("c.*", (F.col("c.offending") == 0).alias("passed"))


def orphan_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges without a source or target node; an edge that lacks both counts twice in ``total``."""
    ids = nodes.select("id")
    a = edges.join(ids, F.col("source") == F.col("id"), "left_anti").agg(F.count("*").alias("no_source"))
    b = edges.join(ids, F.col("target") == F.col("id"), "left_anti").agg(F.count("*").alias("no_target"))
    both = edges.join(ids, F.col("source") == F.col("id"), "left_anti").join(
        ids.select(F.col("id").alias("i2")), F.col("target") == F.col("i2"), "left_anti").agg(F.count("*").alias("no_end"))
    row = a.join(F.broadcast(b)).join(F.broadcast(both))
    return row.withColumn("total", F.col("no_source") + F.col("no_target")).withColumn("edges", F.col("total") - F.col("no_end"))


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by type, source and relation from one grouping-sets pass per table."""
    n = nodes.groupingSets([["type"], ["source"], []], "type", "source").agg(
        F.count("*").alias("n"), F.count_if(F.col("name").isNotNull() & (F.col("name") != "")).alias("with_name")
    ).select(
        F.when(F.col("type").isNotNull(), F.lit("node_type")).when(F.col("source").isNotNull(), F.lit("node_source")).otherwise(F.lit("nodes")).alias("metric"),
        F.coalesce("type", "source", F.lit("all")).alias("value"), "n", F.round(F.col("with_name") * 100 / F.col("n"), 4).alias("pct_named"),
    )
    e = edges.groupingSets([["relation"], ["source_kg"], []], "relation", "source_kg").agg(F.count("*").alias("n")).select(
        F.when(F.col("relation").isNotNull(), F.lit("relation")).when(F.col("source_kg").isNotNull(), F.lit("edge_source")).otherwise(F.lit("edges")).alias("metric"),
        F.coalesce("relation", "source_kg", F.lit("all")).alias("value"), "n", F.lit(None).cast("double").alias("pct_named"),
    )
    return n.unionByName(e)


def name_quality(nodes: DataFrame, patterns: Mapping[str, str], samples: int = 5) -> DataFrame:
    """C14: rows per name pattern with the first samples; per pattern only ``samples`` names meet."""
    tagged = nodes.select("name", F.explode(F.array(*[
        F.when(F.col("name").rlike(p), F.lit(n)) for n, p in patterns.items()])).alias("pattern")).where(F.col("pattern").isNotNull())
    counts = tagged.groupBy("pattern").agg(F.count("*").alias("n"))
    named = tagged.distinct().withColumn("one", F.lit(0))
    w = Window.partitionBy("pattern").orderBy("name")
    first = named.withColumn("r", F.row_number().over(w)).where(F.col("r") <= samples)
    return counts.join(first.groupBy("pattern").agg(F.concat_ws(",", F.array_sort(F.collect_list("name"))).alias("samples")), "pattern")


def relation_families(edges: DataFrame, families: Sequence[str] = RELATION_FAMILIES) -> DataFrame:
    """Relations rolled up to the prefix before '::'."""
    counts = edges.groupBy("relation").agg(F.count("*").alias("n"))
    family = F.split_part(F.lower("relation"), F.lit("::"), F.lit(1))
    known = F.contains("relation", F.lit("::")) & family.isin(*families)
    return counts.withColumn("family", F.when(known, family).otherwise(F.lit("other"))).groupBy("family").agg(
        F.count("*").alias("n_relations"), F.sum("n").alias("n_edges")
    )


def before_after(before: DataFrame, after: DataFrame, key: Sequence[str], value: str = "n") -> DataFrame:
    """Two metric tables side by side with delta and percent."""
    b = before.select(*key, F.col(value).alias("old"))
    a = after.select(*key, F.col(value).alias("new"))
    zero = F.lit(0).cast("bigint")
    return (
        b.join(a, list(key), "full_outer").withColumn("old", F.coalesce("old", zero)).withColumn("new", F.coalesce("new", zero))
        .withColumn("delta", F.col("new") - F.col("old"))
        .withColumn("pct", F.when(F.col("old") > 0, F.round(F.col("delta") * 100 / F.col("old"), 4)))
    )


def keyed_members(nodes: DataFrame, key: Column) -> DataFrame:
    """Members (key, id, source, base) of the groups with more than one row, without collecting a group."""
    keyed = nodes.select(key.alias("key"), "id", "source", T.base_id(F.col("id")).alias("base")).where(F.col("key").isNotNull())
    big = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("key")
    return keyed.join(big, "key", "left_semi")


def name_key() -> Column:
    return F.concat(F.col("type"), F.lit("::"), F.lower(F.trim(F.col("name"))))


def duplicate_groups(members: DataFrame) -> DataFrame:
    """Size and confidence per group from plain aggregates.

    0.95 with one shared base id, 0.80 with several, 0.60 with none; 0.05 more (0.99 at most)
    with several sources.  ``members_key`` identifies the member set (count, sum and xor of
    member hashes), so no group is collected.
    """
    h = F.xxhash64("id")
    n_base = F.countDistinct("base")
    base = F.when(n_base == 1, 0.95).when(n_base > 1, 0.80).otherwise(0.60)
    conf = F.when(F.countDistinct("source") > 1, F.least(base + 0.05, F.lit(0.99))).otherwise(base)
    return members.groupBy("key").agg(
        F.count("*").alias("n"), F.round(conf, 2).alias("confidence"), F.min("id").alias("first_id"),
        F.max("id").alias("last_id"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"),
    )


def group_members(members: DataFrame) -> DataFrame:
    """Every member of a group with its source and base id, and the size and confidence of the group."""
    return members.join(duplicate_groups(members).select("key", "n", "confidence"), "key").select("key", "id", "source", "base", "n", "confidence")


def merged_duplicates(by_name: DataFrame, by_id: DataFrame) -> DataFrame:
    """Id groups (each member set once), then the name groups without a member in any id group.

    Name groups are disjoint from each other, so the greedy scan is one anti join on members.
    """
    id_groups = duplicate_groups(by_id)
    id_groups = id_groups.groupBy("n", "x", "s").agg(F.min_by(F.struct("key", "confidence", "first_id", "last_id"), "key").alias("g")).select(
        "g.*", "n", F.lit("external_id").alias("match_type")
    )
    covered = by_id.select("id").distinct()
    touched = by_name.join(covered, "id", "left_semi").select("key").distinct()
    names = duplicate_groups(by_name.join(touched, "key", "left_anti")).select(
        "key", "confidence", "first_id", "last_id", "n", F.lit("name").alias("match_type")
    )
    return id_groups.unionByName(names)


def first_per_key(df: DataFrame, by: Sequence[str], seq: str) -> DataFrame:
    """First row per key, as a min_by aggregate."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), seq).alias("r")).select(*by, "r.*")


def exclusion_report(edges: DataFrame, relations: Sequence[str]) -> DataFrame:
    removed = F.col("relation").isin(*relations)
    return edges.groupBy("relation").agg(F.count_if(removed).alias("removed"), F.count_if(~removed).alias("kept"))


def undirected_dense(edges: DataFrame) -> DataFrame:
    """Distinct (low, high) edges with nodes numbered from 0 in the order of their ids."""
    from loomgraph.operators.ranking import global_position

    pairs = edges.select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).where("u <> v").distinct()
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    ids = global_position(nodes, [F.col("node")]).select("node", (F.col("position") - 1).alias("number"))
    a = ids.select(F.col("node").alias("u"), F.col("number").alias("a"))
    b = ids.select(F.col("node").alias("v"), F.col("number").alias("b"))
    return pairs.join(a, "u").join(b, "v").select("a", "b")


def without_false_pairs(truth: DataFrame, false_pairs: DataFrame, false_items: Sequence[str], item_word: Mapping[str, str]) -> DataFrame:
    """Named truth (item_name, context_name, ..) minus listed pairs, listed items, and items on
    contexts that hold a listed word."""
    i, c = F.lower("item_name"), F.lower("context_name")
    out = truth.where(~i.isin(*[x.lower() for x in false_items])) if false_items else truth
    for item, word in item_word.items():
        out = out.where(~((i == item.lower()) & F.contains(c, F.lit(word.lower()))))
    pairs = false_pairs.select(F.lower("item_name").alias("fi"), F.lower("context_name").alias("fc")).distinct()
    return out.join(pairs, (i == F.col("fi")) & (c == F.col("fc")), "left_anti")


def allowed_only(truth: DataFrame, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """A listed item stays only on contexts that contain one of its allowed words."""
    i, c = F.lower("item_name"), F.lower("context_name")
    for item, words in allowed.items():
        truth = truth.where((i != item.lower()) | T.contains_any(c, [w.lower() for w in words]))
    return truth


def vector_quality(vectors: DataFrame, by: str) -> DataFrame:
    """NaN, infinite, near-zero and huge vectors, and norm statistics per group."""
    v = V.doubles(F.col("vec"))
    n = vectors.select(by, v.alias("v")).withColumn("norm", V.norm(F.col("v")))
    inf = float("inf")
    return n.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(F.exists("v", F.isnan)).alias("n_nan"),
        F.count_if(F.exists("v", lambda x: F.abs(x) == inf)).alias("n_inf"), F.count_if(F.col("norm") < 1e-10).alias("n_zero"),
        F.count_if(F.exists("v", lambda x: F.abs(x) > 1e6)).alias("n_huge"), F.round(F.min("norm"), 6).alias("min_norm"),
        F.round(F.max("norm"), 6).alias("max_norm"), F.round(F.avg("norm"), 6).alias("mean_norm"), F.round(F.stddev_pop("norm"), 6).alias("std_norm"),
    )


def spot_check(df: DataFrame, id_col: str, n: int = 50) -> DataFrame:
    """N rows in the order of their md5."""
    return df.withColumn("h", F.md5(F.col(id_col).cast("string"))).orderBy("h", id_col).limit(n).drop("h")
