"""G: joins over the edge table. Every traversal starts from given pairs or ends in a bounded top list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import vectors as V
from loomgraph.functions.hashing import seeded_hash
from loomgraph.operators.nearest import nearest_sets
from loomgraph.operators.pairs import SLICE, PairMembers, common_members, linked
from loomgraph.operators.ranking import global_position
from loomgraph.operators.similar import jaccard_of, pair_sizes
from loomgraph.session import cut_lineage


def joined_set(c: Column | str, sep: str = ",") -> Column:
    """Sorted distinct values as one text."""
    return F.concat_ws(sep, F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")))


def links(edges: DataFrame, relations: Sequence[str], left_type: str, right_type: str, a: str, b: str) -> DataFrame:
    """G1: distinct (left, right) ids of the listed relations, whichever way the edge points."""
    e = edges.where(F.col("relation").isin(*relations))
    forward = F.startswith("source", F.lit(left_type + "::"))
    left = F.when(forward, F.col("source")).otherwise(F.col("target"))
    right = F.when(forward, F.col("target")).otherwise(F.col("source"))
    return (
        e.select(left.alias("l"), right.alias("r"))
        .where(F.startswith("l", F.lit(left_type + "::")) & F.startswith("r", F.lit(right_type + "::")))
        .select(F.split_part("l", F.lit("::"), F.lit(2)).alias(a), F.split_part("r", F.lit("::"), F.lit(2)).alias(b))
        .distinct()
    )


def shared_features(pairs: DataFrame, item_features: DataFrame, context_features: DataFrame) -> DataFrame:
    """Features that both ends of a pair have (left rows of pairs without any are kept)."""
    hits = (
        common_members(pairs, item_features, context_features, "item", "context", "feature")
        .groupBy("context", "item").agg(F.count("*").alias("n_shared"), joined_set("feature").alias("shared"))
    )
    return pairs.select("context", "item").join(hits, ["context", "item"], "left").select(
        "context", "item", F.coalesce("n_shared", F.lit(0)).alias("n_shared"), F.coalesce("shared", F.lit("")).alias("shared")
    )


def group_sets(features: DataFrame, feature_groups: DataFrame, key: str) -> DataFrame:
    """Groups that an entity reaches through its features, as (key, feature := group)."""
    return features.join(feature_groups, "feature").select(key, F.col("grp").alias("feature")).distinct()


def overlap_top(contexts: DataFrame, items: DataFrame, n: int = 30) -> DataFrame:
    """Items that hit most features of a context; ties to the lower id."""
    return nearest_sets(
        contexts.select(F.col("context").alias("id"), "feature"), items.select(F.col("item").alias("id"), "feature"),
        n, metric="overlap", names=("context", "item", "score"),
    ).select("context", "item", F.col("score").cast("bigint").alias("score"), F.col("place").alias("rank"))


def two_hop_paths(pairs: DataFrame, item_features: DataFrame, net: DataFrame, context_features: DataFrame) -> DataFrame:
    """Item -> g1 - g2 -> context where g1 is no feature of the context."""
    both = net.select(F.col("a").alias("feature"), F.col("b").alias("bridge")).unionByName(
        net.select(F.col("b").alias("feature"), F.col("a").alias("bridge"))
    )
    ends = context_features.select("context", F.col("feature").alias("bridge"))
    return (
        pairs.select("context", "item").join(item_features, "item")
        .join(context_features, ["context", "feature"], "left_anti")
        .join(both, "feature").join(ends, ["context", "bridge"])
    )


def neighbourhood(net: DataFrame, hops: int) -> DataFrame:
    """(feature, reached) within n hops, starting from every feature of the net; lineage cut per hop."""
    step = net.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(net.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct()
    reach = step.select(F.col("x").alias("feature"), F.col("y").alias("reached"))
    for _ in range(hops - 1):
        more = reach.join(step, reach.reached == step.x).select("feature", F.col("y").alias("reached"))
        reach = cut_lineage(reach.unionByName(more).distinct())
    return reach


def extended_features(features: DataFrame, net: DataFrame, key: str, hops: int = 1) -> DataFrame:
    """An entity's features grown n hops over the net."""
    reach = neighbourhood(net, hops)
    grown = features.join(reach, "feature").select(key, F.col("reached").alias("feature"))
    return features.select(key, "feature").unionByName(grown).distinct()


def weighted_overlap(pairs: DataFrame, extended: DataFrame, context_features: DataFrame, feature_groups: DataFrame, same: float = 1.0, other: float = 0.5, item_groups_of: DataFrame | None = None) -> DataFrame:
    """An overlapping feature counts ``same`` if it shares a group with the item's features, else ``other``.

    The item's groups come from the extended features, or from ``item_groups_of`` if given.
    """
    hit = pairs.select("context", "item").join(extended, "item").join(context_features, ["context", "feature"])
    item_groups = (extended if item_groups_of is None else item_groups_of).join(feature_groups, "feature").select("item", "grp").distinct()
    near = (
        hit.select("item", "feature").distinct().join(feature_groups, "feature")
        .join(item_groups, ["item", "grp"], "left_semi").select("item", "feature").distinct().withColumn("near", F.lit(1))
    )
    scored = hit.join(near, ["item", "feature"], "left").groupBy("context", "item").agg(
        F.sum(F.when(F.col("near") == 1, same).otherwise(other)).alias("score")
    )
    return pairs.select("context", "item").join(scored, ["context", "item"], "left").select(
        "context", "item", F.coalesce("score", F.lit(0.0)).alias("score")
    )


def adjacency(edges: DataFrame) -> DataFrame:
    """Undirected neighbour pairs (node, neighbour), distinct."""
    return edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour")).unionByName(
        edges.select(F.col("target").alias("node"), F.col("source").alias("neighbour"))
    ).distinct()


def pair_topology(pairs: DataFrame, edges: DataFrame, a: str, b: str, feature_type: str = "Feature") -> DataFrame:
    """Eleven topological features of each (a, b) pair of node ids."""
    adj = cut_lineage(adjacency(edges))
    is_feature = F.startswith("neighbour", F.lit(feature_type + "::"))
    deg = cut_lineage(adj.groupBy("node").agg(F.count("*").alias("degree"), F.count_if(is_feature).alias("features")))
    pairs = cut_lineage(pairs.select(a, b).distinct())
    # what a common neighbour adds follows from it alone; only the neighbours of the pairs' ends look it up
    weight = deg.select(F.col("node").alias("neighbour"), F.when(F.col("degree") > 1, 1.0 / F.log("degree")).otherwise(0.0).alias("weight"))
    ends = pairs.select(F.col(a).alias("node")).unionByName(pairs.select(F.col(b).alias("node"))).distinct()
    links = cut_lineage(adj.join(ends, "node", "left_semi")).join(weight, "neighbour").select("node", F.col("neighbour").alias("mid"), "weight")
    members = PairMembers.of_nodes(pairs, links, a, b, "mid", ["weight"])
    common = members.common(members.sized(pairs)).groupBy(a, b).agg(
        F.count("*").alias("n_common"),
        F.count_if(F.startswith("mid", F.lit(feature_type + "::"))).alias("n_common_features"),
        F.sum("weight").alias("adamic_adar"),
    )
    direct = linked(pairs, members).withColumn("direct", F.lit(1))
    da = deg.select(F.col("node").alias(a), F.col("degree").alias("degree_a"), F.col("features").alias("features_a"))
    db = deg.select(F.col("node").alias(b), F.col("degree").alias("degree_b"), F.col("features").alias("features_b"))
    zero = F.lit(0).cast("bigint")
    out = pairs.join(common, [a, b], "left").join(direct, [a, b], "left").join(da, a, "left").join(db, b, "left")
    ints = ["degree_a", "degree_b", "n_common", "n_common_features", "direct", "features_a", "features_b"]
    for c in ints:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("bigint"), zero))
    return out.select(
        a, b, *ints,
        F.round(jaccard_of(F.col("n_common"), F.col("degree_a"), F.col("degree_b")), 6).alias("jaccard"),
        F.round(F.coalesce("adamic_adar", F.lit(0.0)), 4).alias("adamic_adar"),
        F.round(F.log1p("degree_a"), 4).alias("log_degree_a"), F.round(F.log1p("degree_b"), 4).alias("log_degree_b"),
    )


def profile_members(edges: DataFrame, node_type: str, treatment_word: str = "treat") -> DataFrame:
    """(node, kind, neighbour) of each node of a type; treatment edges of both directions are one kind."""
    prefix = F.lit(node_type + "::")
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "relation").unionByName(
        edges.select(F.col("target").alias("node"), F.col("source").alias("other"), "relation")
    ).where(F.startswith("node", prefix))
    kind = F.when(F.contains(F.lower("relation"), F.lit(treatment_word)), F.lit("treatments")).otherwise(
        F.split_part("other", F.lit("::"), F.lit(1))
    )
    return both.select("node", kind.alias("kind"), F.col("other").alias("neighbour")).distinct()


def profile(edges: DataFrame, node_type: str, treatment_word: str = "treat") -> DataFrame:
    """The neighbours of each node by kind, counted."""
    return profile_members(edges, node_type, treatment_word).groupBy("node", "kind").agg(
        F.count("*").alias("n"), F.min("neighbour").alias("first"), F.max("neighbour").alias("last")
    )


def coverage_ranking(gene_lists: DataFrame, item_features: DataFrame, n: int = 30) -> DataFrame:
    """Items by features hit, then by specificity (hits / own features). Rows may repeat in both tables."""
    best = nearest_sets(
        gene_lists.select(F.col("context").alias("id"), "feature"), item_features.select(F.col("item").alias("id"), "feature"),
        n, metric="coverage", names=("context", "item", "hits"),
    )
    return best.select(
        "context", "item", F.col("hits").cast("bigint").alias("hits"),
        F.round(F.col("hits") / F.col("listed"), 6).alias("coverage"), F.round(F.col("hits") / F.col("size"), 6).alias("specificity"), F.col("place").alias("rank"),
    )


def random_walks(edges: DataFrame, walks: int = 10, steps: int = 80, seed: int = 42, cut_every: int = 5, rows: int = SLICE) -> DataFrame:
    """Uniform walks from every node, long form (start, walk, step, node).

    Nodes are numbered in the order of their names. A walker meets its node as one row with the sorted numbers of
    its neighbours. Of a node with more than ``rows`` neighbours these are rows found by (node, number), so a hub
    is never in one row and the walkers at it spread over its numbers.
    """
    ends = cut_lineage(edges.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target"))
    names = ends.select(F.col("source").alias("name")).unionByName(ends.select(F.col("target").alias("name"))).distinct()
    names = cut_lineage(global_position(names, [F.col("name")], name="node"))
    kind = "int" if names.count() < 2**31 else "bigint"
    names = names.withColumn("node", F.col("node").cast(kind))
    for end, to in (("source", "a"), ("target", "b")):
        ends = ends.join(names.select(F.col("name").alias(end), F.col("node").alias(to)), end).drop(end)
    links = cut_lineage(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    adj = links.toDF("node", "neighbour").unionByName(links.where("a <> b").select(F.col("b").alias("node"), F.col("a").alias("neighbour")))
    hubs = cut_lineage(adj.groupBy("node").agg(F.count("*").cast("int").alias("degree")).where(F.col("degree") > rows))
    hubs_exist = not hubs.isEmpty()
    few = adj.join(hubs, "node", "left_anti") if hubs_exist else adj
    packed = few.groupBy("node").agg(F.sort_array(F.collect_list("neighbour")).alias("near")).withColumn("degree", F.size("near"))
    if hubs_exist:
        packed = packed.unionByName(hubs, allowMissingColumns=True)
        of_hubs = global_position(adj.join(hubs.select("node"), "node", "left_semi"), [F.col("neighbour")], ["node"], name="place")
        far = cut_lineage(of_hubs.select("node", (F.col("place") - 1).cast("int").alias("number"), F.col("neighbour").alias("far")))
    packed = cut_lineage(packed)
    at = names.select(F.col("name").alias("start"), "node").withColumn("walk", F.explode(F.sequence(F.lit(1), F.lit(walks))))
    trail = at.select("start", "walk", F.lit(0).alias("step"), F.col("start").alias("node"))
    none = F.array().cast(f"array<{kind}>")
    at = at.withColumn("nodes", none)
    since = 0
    for step in range(1, steps + 1):
        pick = F.pmod(seeded_hash(seed, F.col("start"), F.col("walk"), F.lit(step)), F.col("degree"))
        at, to = at.join(packed, "node").withColumn("number", pick.cast("int")), F.get("near", F.col("number"))
        if hubs_exist:
            at, to = at.join(far, ["node", "number"], "left"), F.coalesce(to, F.col("far"))
        at = at.select("start", "walk", to.alias("node"), F.concat("nodes", F.array(to)).alias("nodes"))
        if step - since == cut_every or step == steps:
            at = cut_lineage(at)  # each stretch of steps is walked and written once
            stretch = at.select("start", "walk", F.posexplode("nodes").alias("step", "node")).withColumn("step", F.col("step") + since + 1)
            trail = trail.unionByName(stretch.join(names, "node").select("start", "walk", "step", F.col("name").alias("node")))
            at, since = at.withColumn("nodes", none), step
    return trail


def neighbour_mean(pairs: DataFrame, vectors: DataFrame, node: str, neighbour: str, how: str = "mean") -> DataFrame:
    """Element-wise mean (or max) of the neighbours' vectors, long form (node, pos, value)."""
    v = vectors.select(F.col(vectors.columns[0]).alias(neighbour), V.doubles(F.col("vec")).alias("v"))
    agg = F.avg("x") if how == "mean" else F.max("x")
    return pairs.join(v, neighbour).select(node, F.posexplode("v").alias("pos", "x")).groupBy(node, "pos").agg(F.round(agg, 6).alias("value"))


def disconnected(wanted: DataFrame, embedded: DataFrame, edges: DataFrame, key: str, node: Column) -> DataFrame:
    """Wanted entities without a vector, with their edge counts by relation."""
    lost = wanted.select(key).distinct().join(embedded.select(key), key, "left_anti").withColumn("node", node)
    ends = edges.select(F.col("source").alias("node"), "relation").unionByName(edges.select(F.col("target").alias("node"), "relation"))
    return lost.join(ends, "node", "left").groupBy(key).agg(
        F.count("relation").alias("n_edges"), F.count_if(F.col("relation") == "treats").alias("n_treats"),
        F.countDistinct("relation").alias("n_relations"),
    )


def pair_overlap(pairs: DataFrame, item_features: DataFrame, context_features: DataFrame) -> DataFrame:
    """Overlap count and set sizes of (context, item) pairs."""
    return pair_sizes(pairs, item_features, context_features, "item", "context").withColumnsRenamed(
        {"shared": "overlap", "size_a": "n_item_features", "size_b": "n_context_features"}
    )


def mechanism_trace(pairs: DataFrame, item_features: DataFrame, context_features: DataFrame, feature_groups: DataFrame) -> DataFrame:
    """Direct or indirect mechanism, shared groups, bridge features and a hypothesis line."""
    ids = ["context", "item"]
    direct = shared_features(pairs, item_features, context_features).select(*ids, F.col("n_shared").alias("n_direct"))
    c_groups = group_sets(context_features, feature_groups, "context")
    groups = shared_features(pairs, group_sets(item_features, feature_groups, "item"), c_groups)
    groups = groups.select(*ids, F.col("n_shared").alias("n_groups"), F.col("shared").alias("groups"))
    bridge = (
        pairs.select(*ids).join(item_features, "item").join(feature_groups, "feature")
        .join(c_groups.select("context", F.col("feature").alias("grp")), ["context", "grp"])
        .groupBy(*ids).agg(F.countDistinct("feature").alias("n_bridge"))
    )
    out = direct.join(groups, ids).join(bridge, ids, "left").withColumn("n_bridge", F.coalesce("n_bridge", F.lit(0)))
    some = F.col("n_direct") > 0
    return out.select(
        *ids, F.when(some, F.lit("DIRECT")).otherwise(F.lit("INDIRECT")).alias("mechanism"), "n_direct", "n_groups", "groups", "n_bridge",
        F.when(some, F.format_string("item %d directly modulates %d features", "item", "n_direct"))
        .when(F.col("n_bridge") > 0, F.format_string("item %d reaches %d shared groups through %d features", "item", "n_groups", "n_bridge"))
        .otherwise(F.lit("mechanism unclear")).alias("hypothesis"),
    )
