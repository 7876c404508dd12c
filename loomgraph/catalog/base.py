"""Registry of runnable queries with their SQL twins, and the shared SQL views."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL_BODY: dict[str, str] = {}
VIEWS: dict[str, str] = {}
RECURSIVE: set[str] = set()


def entry(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``, with its SQL twin if there is one."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            SQL_BODY[name] = sql
        return fn

    return add


def view(name: str, sql: str, recursive: bool = False) -> None:
    VIEWS[name] = sql
    if recursive:
        RECURSIVE.add(name)


def restated(view_name: str, changed: dict[str, str], prefix: str) -> str:
    """Define again, under ``prefix``, every view that ``view_name`` is built from and that reads a changed view."""
    names = dict(changed)
    for name, text in list(VIEWS.items()):
        new = re.sub(r"\b\w+_v\b|\bmoved_\d+v\b", lambda m: names.get(m[0], m[0]), text)
        if name not in changed and name not in changed.values() and new != text:
            VIEWS[prefix + name] = new
            names[name] = prefix + name
        if name == view_name:
            break
    return names[view_name]


def full_sql(body: str) -> str:
    """Prefix a body with the shared views it uses, in order of definition."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(
        f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({VIEWS[n]})" for n in VIEWS if n in needed
    )
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    return f"WITH RECURSIVE {ctes},\n{body[own.end():]}" if own else f"WITH RECURSIVE {ctes}\n{body}"


def bars(*words: str) -> str:
    """SQL regex alternation of literal words."""
    return "(" + "|".join(re.escape(w) for w in words) + ")"


# ---- concept tables -------------------------------------------------------------------
view("contexts_v", """
  SELECT c_custkey AS context, lower(c_mktsegment || ' ' || n_name) AS name, lower(c_mktsegment) AS category,
         c_name AS title, c_nationkey AS nation, c_acctbal AS balance
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
view("items_v", """
  SELECT p_partkey AS item, p_name AS name, p_type AS class1, p_type || '/' || p_brand AS class2,
         p_brand AS brand, p_size AS size, p_retailprice AS price FROM part""")
view("order_lines_v", "SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
view("truth_v", "SELECT DISTINCT o_custkey AS context, l_partkey AS item FROM order_lines_v WHERE l_returnflag = 'R'")
view("truth_extra_v", "SELECT DISTINCT o_custkey AS context, l_partkey AS item FROM order_lines_v WHERE l_returnflag = 'A'")
view("item_features_v", "SELECT DISTINCT l_partkey AS item, l_suppkey AS feature FROM lineitem")
view("context_features_v", """
  SELECT DISTINCT o_custkey AS context, l_suppkey AS feature FROM order_lines_v""")
view("feature_groups_v", "SELECT s_suppkey AS feature, s_nationkey AS grp FROM supplier")
view("feature_net_v", """
  SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (
    SELECT s_suppkey AS a, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS b FROM supplier
    UNION ALL
    SELECT s_suppkey, lead(s_suppkey) OVER (PARTITION BY n_regionkey ORDER BY s_suppkey)
    FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE b IS NOT NULL""")
view("vectors_v", "SELECT vec_id AS context, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings")
view("item_vectors_v", "SELECT vec_id AS item, list_reverse(CAST(embedding AS DOUBLE[])) AS vec, label FROM embeddings")
view("edges_v", """
  SELECT 'Item::' || item AS source, 'treats' AS relation, 'Context::' || context AS target, 'orders' AS source_kg FROM truth_v
  UNION ALL SELECT 'Item::' || item, 'targets', 'Feature::' || feature, 'lineitem' FROM item_features_v
  UNION ALL SELECT 'Context::' || context, 'associated_with', 'Feature::' || feature, 'orders' FROM context_features_v
  UNION ALL SELECT 'Feature::' || feature, 'member_of', 'Group::' || grp, 'supplier' FROM feature_groups_v
  UNION ALL SELECT 'Feature::' || a, 'interacts_with', 'Feature::' || b, 'supplier' FROM feature_net_v""")

# ---- neighbours, vote and ranking -----------------------------------------------------
view("train_v", "SELECT context, vec FROM vectors_v WHERE context IN (SELECT context FROM truth_v)")
view("pairs_v", """
  SELECT q.context AS context, t.context AS neighbour, round(list_cosine_similarity(q.vec, t.vec), 6) AS similarity
  FROM vectors_v q, train_v t""")
view("near_v", """
  SELECT context, neighbour, similarity, place FROM (
    SELECT *, row_number() OVER (PARTITION BY context ORDER BY similarity DESC, neighbour) AS place FROM pairs_v)
  WHERE place <= 20""")
view("vote_v", """
  SELECT n.context AS context, t.item AS item, round(sum(n.similarity), 6) AS score
  FROM near_v n JOIN truth_v t ON n.neighbour = t.context GROUP BY 1, 2""")
view("top_v", """
  SELECT context, item, score, rank, CASE WHEN max(score) OVER (PARTITION BY context) > 0
         THEN score / max(score) OVER (PARTITION BY context) ELSE 0 END AS norm_score FROM (
    SELECT *, row_number() OVER (PARTITION BY context ORDER BY score DESC, item) AS rank FROM vote_v) WHERE rank <= 30""")
