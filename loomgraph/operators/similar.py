"""K: votes and scores built on the nearest-neighbour joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import vectors as V
from loomgraph.functions.hashing import seeded_hash
from loomgraph.operators.nearest import BLOCK_ROWS, nearest_by_draw, nearest_vectors
from loomgraph.operators.pairs import SLICE, PairMembers, of_ends
from loomgraph.operators.pivots import labels_above, nearest_exact
from loomgraph.operators.ranking import global_position, hash_position, top_n
from loomgraph.session import cut_lineage


def as_points(vectors: DataFrame, id_col: str = "context", *keep: str) -> DataFrame:
    return vectors.select(F.col(id_col).alias("id"), "vec", *keep)


def training_vectors(vectors: DataFrame, truth: DataFrame) -> DataFrame:
    """Vectors of the contexts that have at least one truth pair."""
    return vectors.join(truth.select("context").distinct(), "context", "left_semi")


def nearest_contexts(vectors: DataFrame, truth: DataFrame, k: int = 20, exclude_self: bool = False, block_rows: int = BLOCK_ROWS, **kw) -> DataFrame:
    """K2: the k training contexts closest to every context with a vector.

    More vectors than one block holds go through the pivot index; the rows are the same.
    """
    keep = ["category"] if kw.get("boosted") else []
    queries, corpus = as_points(vectors, "context", *keep), as_points(training_vectors(vectors, truth), "context", *keep)
    if "floor" in kw:
        return nearest_vectors(queries, corpus, k, exclude_self=exclude_self, block_rows=block_rows, **kw)
    return nearest_exact(queries, corpus, k, vectors.count(), block_rows, exclude_self=exclude_self, **kw)


def vote(neighbours: DataFrame, truth: DataFrame, by: Sequence[str] = (), items: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """K3: score of an item = sum of the similarities of the neighbours it is true for.

    The rows of a context (k neighbours with their items) go to one task, which adds up its items; a ranking by
    context needs no second shuffle.
    """
    if items is not None:
        truth = truth.join(items.select("item").distinct(), "item", "left_semi")
    known = truth.select(*by, F.col("context").alias("neighbour"), "item")
    return (
        neighbours.join(known, [*by, "neighbour"])
        .select(*by, "context", "item", "similarity").repartition(*by, "context")
        .groupBy(*by, "context", "item")
        .agg(F.round(F.sum("similarity"), digits).alias("score"))
    )


def without_self(neighbours: DataFrame, k: int) -> DataFrame:
    """The k nearest other contexts, from the k + 1 nearest with the context itself among them or not."""
    return top_n(neighbours.where(F.col("context") != F.col("neighbour")).drop("place"), ["context"], "similarity", "neighbour", k, "place")


def vote_any(similarities: DataFrame, truth: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """The vote over any similarity table (context, neighbour, similarity)."""
    s = similarities.where(F.col("context") != F.col("neighbour")) if exclude_self else similarities
    return vote(top_n(s, ["context"], "similarity", "neighbour", k, "place"), truth)


def hybrid_similarity(first: DataFrame, second: DataFrame, alpha: float, digits: int = 9) -> DataFrame:
    """alpha*s1 + (1-alpha)*s2 over the pairs of ``second``; s1 = 0 where missing."""
    a = first.select("context", "neighbour", F.col("similarity").alias("s1"))
    b = second.select("context", "neighbour", F.col("similarity").alias("s2"))
    return b.join(a, ["context", "neighbour"], "left").select(
        "context", "neighbour",
        F.round(alpha * F.coalesce("s1", F.lit(0.0)) + (1 - alpha) * F.col("s2"), digits).alias("similarity"),
    )


def pair_sizes(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str, feature: str = "feature") -> DataFrame:
    """Set sizes and intersection of given (a, b) pairs from two long tables (a|b, feature).

    Only the listed pairs meet, with the members of the smaller set; large sets are expanded and probed.
    Sets that no pair names aren't sent; other columns of ``pairs`` are left behind until the pairs are counted.
    """
    pairs = cut_lineage(pairs)
    wide = len(pairs.columns) > 2
    ends = cut_lineage(pairs.select(a, b).distinct()) if wide else pairs
    members = PairMembers(*of_ends(ends, left, right, a, b), a, b, feature)
    out = members.counted(cut_lineage(members.sized(ends)))
    if not wide:
        return out
    out = out.withColumnsRenamed({a: "__a", b: "__b"})
    return pairs.join(out, F.col(a).eqNullSafe(F.col("__a")) & F.col(b).eqNullSafe(F.col("__b"))).drop("__a", "__b")


def jaccard_of(shared: Column, size_a: Column, size_b: Column) -> Column:
    """K5, K7: shared / union, 0 when both sets are empty."""
    union = size_a + size_b - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def pair_jaccard(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str, name: str = "jaccard", digits: int = 6) -> DataFrame:
    sized = pair_sizes(pairs, left, right, a, b)
    return sized.withColumn(
        name, F.round(jaccard_of(F.col("shared"), F.col("size_a"), F.col("size_b")), digits)
    ).drop("shared", "size_a", "size_b")


def renamed_feature(features: DataFrame, old: str, new: str) -> DataFrame:
    return features.select(F.col(old).alias(new), "feature")


def weighted_jaccard(pairs: DataFrame, kinds: Mapping[str, tuple[DataFrame, float]], digits: int = 6) -> DataFrame:
    """K5: weighted sum of the Jaccard similarity over several kinds of features.

    ``kinds`` maps a name to (long table (context, feature), weight).
    """
    out = pairs
    for kind, (features, _) in kinds.items():
        right = renamed_feature(features, "context", "neighbour")
        out = pair_jaccard(out, features, right, "context", "neighbour", f"j_{kind}", digits=12)
    total = sum(F.col(f"j_{kind}") * w for kind, (_, w) in kinds.items())
    return out.withColumn("similarity", F.round(total, digits)).drop(*[f"j_{k}" for k in kinds])


def translation_top(contexts: DataFrame, items: DataFrame, relation: Sequence[float], n: int = 30) -> DataFrame:
    """K8: items ranked by -||item + relation - context||: nearest items to (context - relation)."""
    r = F.array(*[F.lit(float(x)) for x in relation])
    queries = contexts.select(F.col("context").alias("id"), V.minus(V.doubles(F.col("vec")), r).alias("vec"))
    corpus = items.select(F.col("item").alias("id"), V.doubles(F.col("vec")).alias("vec"))
    return nearest_vectors(queries, corpus, n, metric="euclid", names=("context", "item", "score")).withColumnRenamed("place", "rank")


def draw_neighbours(
    vectors: DataFrame, truth: DataFrame, draws: int = 10, ratio: float = 0.8, k: int = 20, seed: int = 42, exclude_self: bool = False,
) -> DataFrame:
    """(context, neighbour, similarity, draws): the k nearest of each draw of the training contexts without replacement.

    A draw is a bit of a mask on the training contexts, so all draws share one comparison of each pair.
    """
    train = training_vectors(vectors, truth).select("context", "vec")
    tickets = train.select("context", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn(
        "h", seeded_hash(seed, F.col("draw"), F.col("context"))
    )
    chosen = (
        hash_position(tickets, "h", "context", ["draw"]).where(F.col("position") <= F.floor(F.col("group_size") * ratio))
        .groupBy("context").agg(F.sum(F.expr("shiftleft(1L, draw - 1)")).alias("draws"))
    )
    corpus = cut_lineage(train.join(chosen, "context").select(F.col("context").alias("id"), "vec", "draws"))
    near = nearest_by_draw(as_points(vectors), corpus, k, draws, exclude_self=exclude_self)
    return near.select(F.col("q_id").alias("context"), F.col("c_id").alias("neighbour"), F.col("score").alias("similarity"), "draws")


def _draw_sums(near: DataFrame, truth: DataFrame, draws: int, digits: int) -> DataFrame:
    """(context, item, scores): the vote of each draw, null where no neighbour of it holds the item."""
    known = truth.select(F.col("context").alias("neighbour"), "item")
    in_draw = lambda d: F.expr(f"shiftright(draws, {d}) & 1") == 1
    sums = [F.round(F.sum(F.when(in_draw(d), F.col("similarity"))), digits).alias(f"d{d}") for d in range(draws)]
    return near.join(known, "neighbour").groupBy("context", "item").agg(*sums).select("context", "item", F.array(*[f"d{d}" for d in range(draws)]).alias("scores"))


def draw_votes(
    vectors: DataFrame, truth: DataFrame, draws: int = 10, ratio: float = 0.8, k: int = 20, seed: int = 42,
    exclude_self: bool = False, digits: int = 12,
) -> DataFrame:
    """One vote per draw of the training contexts without replacement, all draws in one plan."""
    near = draw_neighbours(vectors, truth, draws, ratio, k, seed, exclude_self)
    return (
        _draw_sums(near, truth, draws, digits).select("context", "item", F.posexplode("scores").alias("draw", "score"))
        .where(F.col("score").isNotNull()).select((F.col("draw") + 1).alias("draw"), "context", "item", "score")
    )


def subsample_votes(vectors: DataFrame, truth: DataFrame, draws: int = 10, digits: int = 9, **kw) -> DataFrame:
    """Votes averaged over the draws; an absent item counts 0."""
    near = draw_neighbours(vectors, truth, draws, **kw)
    total = F.aggregate("scores", F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    return _draw_sums(near, truth, draws, 12).select("context", "item", F.round(total / draws, digits).alias("score"))


def multi_k_scores(neighbours: DataFrame, truth: DataFrame, ks: Sequence[int] = (15, 20, 25, 30), top: int = 30) -> DataFrame:
    """One neighbour table at the largest k; mean of score/max and Borda points over the ks."""
    sized = neighbours.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("place") <= F.col("k"))
    known = truth.select(F.col("context").alias("neighbour"), "item")
    votes = sized.join(known, "neighbour").groupBy("context", "k", "item").agg(F.round(F.sum("similarity"), 6).alias("score"))
    w = Window.partitionBy("context", "k")
    placed = votes.withColumn("best", F.max("score").over(w)).withColumn(
        "rank", F.row_number().over(w.orderBy(F.col("score").desc(), "item"))
    )
    return placed.groupBy("context", "item").agg(
        F.round(F.sum(F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(0.0)) / len(ks), 9).alias("mean_score"),
        F.round(F.sum(F.when(F.col("rank") <= top, (top - F.col("rank")) / top).otherwise(0.0)), 9).alias("borda"),
    )


def own_k(neighbours: DataFrame, categories: DataFrame, k_of: Mapping[str, int], default: int) -> DataFrame:
    """Neighbours kept up to the k of the query's category."""
    k = F.lit(default)
    for cat, n in k_of.items():
        k = F.when(F.col("category") == cat, n).otherwise(k)
    return neighbours.join(categories.select("context", "category"), "context", "left").where(F.col("place") <= k)


def neighbour_category_share(neighbours: DataFrame, categories: DataFrame) -> DataFrame:
    """Share of the neighbours in the category of the query."""
    other = categories.select(F.col("context").alias("neighbour"), F.col("category").alias("n_category"))
    return (
        neighbours.join(categories.select("context", "category"), "context")
        .join(other, "neighbour")
        .groupBy("context", "category")
        .agg(F.round(F.avg((F.col("category") == F.col("n_category")).cast("double")), 6).alias("coherence"))
    )


def shared_item_density(neighbours: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean number and mean Jaccard of items shared with the neighbours."""
    left = truth.select("context", F.col("item").alias("feature"))
    right = truth.select(F.col("context").alias("neighbour"), F.col("item").alias("feature"))
    sized = pair_sizes(neighbours.select("context", "neighbour"), left, right, "context", "neighbour")
    return sized.groupBy("context").agg(
        F.round(F.avg("shared"), 6).alias("mean_shared"),
        F.round(F.avg(jaccard_of(F.col("shared"), F.col("size_a"), F.col("size_b"))), 6).alias("mean_jaccard"),
    )


def centrality(vectors: DataFrame, digits: int = 6) -> DataFrame:
    """Mean cosine of a context to all others = (unit . sum of units - 1) / (n - 1).

    The sum vector is one small aggregate; no pair is formed.
    """
    v = V.doubles(F.col("vec"))
    units = vectors.select("context", v.alias("v")).withColumn("size", V.norm(F.col("v"))).select(
        "context", F.transform("v", lambda x: F.when(F.col("size") > 0, x / F.col("size")).otherwise(0.0)).alias("unit")
    )
    totals = (
        units.select(F.posexplode("unit").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias("total"))
    )
    n = vectors.agg(F.count("*").alias("n"))
    one = totals.join(F.broadcast(n))
    return units.join(F.broadcast(one)).select(
        "context",
        F.round((V.dot(F.col("unit"), F.col("total")) - V.dot(F.col("unit"), F.col("unit"))) / (F.col("n") - 1), digits).alias("centrality"),
    )


def class_transfer(neighbours: DataFrame, truth: DataFrame, classes: DataFrame, n: int = 30, chunk: int = 64) -> DataFrame:
    """neighbours' items lend their class a similarity; other items of the class inherit it.

    Items with the same classes have the same score in every context, so contexts meet such kinds of items and
    not the items. A kind counts until better ones hold ``n`` items that are free to take; of a kind only the first
    ``n`` and as many more as its context refers to are laid out, in chunks of its items by id.
    """
    known = truth.select(F.col("context").alias("neighbour"), "item")
    referred = cut_lineage(neighbours.join(known, "neighbour").select("context", "item", "similarity"))
    per_class = referred.join(classes, "item").groupBy("context", "cls").agg(F.round(F.sum("similarity"), 6).alias("class_score"))
    reference = cut_lineage(referred.select("context", "item").distinct())
    keys = cut_lineage(classes.where(F.col("cls").isNotNull()).groupBy("item").agg(F.sort_array(F.collect_list("cls")).alias("key")))
    kinds = cut_lineage(keys.select("key").distinct().withColumn("kind", F.monotonically_increasing_id()))
    members = cut_lineage(global_position(keys.join(kinds, "key").select("kind", "item"), [F.col("item")], ["kind"], name="place"))
    scored = per_class.join(kinds.select("kind", F.explode("key").alias("cls")), "cls").groupBy("context", "kind").agg(F.round(F.sum("class_score"), 6).alias("score"))
    taken = reference.join(members.select("kind", "item"), "item").groupBy("context", "kind").agg(F.count("*").alias("taken"))
    sized = scored.join(members.groupBy("kind").agg(F.count("*").alias("size")), "kind").join(taken, ["context", "kind"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    free = F.sum(F.col("size") - F.col("taken"))
    to_here = Window.partitionBy("context").orderBy(F.col("score").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    better = free.over(to_here) - free.over(Window.partitionBy("context", "score"))
    asked = sized.withColumn("better", better).where(F.col("better") < n).select("context", "kind", "score", F.least("size", F.col("taken") + n).alias("most"))
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("most") - 1) / chunk).cast("int"))))
    chunks = members.groupBy("kind", F.floor((F.col("place") - 1) / chunk).cast("int").alias("chunk")).agg(F.collect_list(F.struct("place", "item")).alias("near"))
    laid = asked.join(chunks, ["kind", "chunk"]).select("context", "score", F.explode(F.filter("near", lambda m: m["place"] <= F.col("most"))).alias("m"))
    return top_n(laid.select("context", "m.item", "score").join(reference, ["context", "item"], "left_anti"), ["context"], "score", "item", n)


def similarity_mean(similar: DataFrame, truth: DataFrame, n: int = 30) -> DataFrame:
    """Mean similarity of the similar contexts an item is true for.

    Similarities have six decimals: they are summed as whole millionths and the mean is rounded half up
    in whole numbers, so the order of the sum doesn't matter.
    """
    known = truth.select(F.col("context").alias("neighbour"), "item")
    scored = (
        similar.join(known, "neighbour").groupBy("context", "item")
        .agg(F.sum(F.round(F.col("similarity") * 1e6).cast("bigint")).alias("s"), F.count("*").alias("n"))
        .select("context", "item", (F.expr("(2 * s + n - pmod(2 * s + n, 2 * n)) div (2 * n)") / 1e6).alias("score"))
    )
    return top_n(scored, ["context"], "score", "item", n)


def merge_average(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two candidate lists, the average where both list a pair."""
    x = a.select("context", "item", F.col("score").alias("s1"))
    y = b.select("context", "item", F.col("score").alias("s2"))
    return x.join(y, ["context", "item"], "full_outer").select(
        "context", "item",
        F.round(F.when(F.col("s1").isNull(), F.col("s2")).when(F.col("s2").isNull(), F.col("s1"))
                .otherwise((F.col("s1") + F.col("s2")) / 2), 9).alias("score"),
    )


def attention_weights(neighbours: DataFrame) -> DataFrame:
    """Softmax of the similarities inside the k neighbours of a query."""
    w = Window.partitionBy("context")
    return neighbours.withColumn("weight", F.exp("similarity") / F.sum(F.exp("similarity")).over(w))


def attention_transfer(neighbours: DataFrame, truth: DataFrame, item_vectors: DataFrame, candidates: DataFrame, floor: float = 0.8) -> DataFrame:
    """Weight of the neighbours that hold an item with a cosine above ``floor`` to the candidate."""
    weighted = attention_weights(neighbours).select("context", "neighbour", "weight")
    # per item the contexts that hold an item as near; the pairs of items stay in their cells
    holders = truth.select(F.col("item").alias("id"), F.col("context").alias("label"))
    points = as_points(item_vectors, "item")
    near = labels_above(points, points, holders, floor + 1e-6).select(F.col("q_id").alias("item"), F.col("label").alias("neighbour"))
    hit = (
        candidates.select("context", "item").distinct().join(weighted, "context").join(near, ["item", "neighbour"], "left_semi")
        .select("context", "item", "neighbour", "weight")
    )
    return hit.groupBy("context", "item").agg(F.round(F.sum("weight"), 4).alias("score"))


def pair_cosine(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str, name: str = "cosine", digits: int = 6) -> DataFrame:
    """K1 on given pairs."""
    l = left.select(F.col(left.columns[0]).alias(a), V.doubles(F.col("vec")).alias("__u"))
    r = right.select(F.col(right.columns[0]).alias(b), V.doubles(F.col("vec")).alias("__v"))
    return (
        pairs.join(l, a).join(r, b)
        .withColumn(name, F.round(V.cosine(F.col("__u"), F.col("__v")), digits))
        .drop("__u", "__v")
    )


def best_known_match(candidates: DataFrame, truth: DataFrame, item_features: DataFrame, digits: int = 6, rows: int = SLICE) -> DataFrame:
    """Best Tanimoto similarity of a candidate to the other known items of its context.

    The features of an item travel as one array to the contexts that list or know it, and pairs are formed there,
    so what is sent is a row per candidate and per known item, not per pair. Of a context with very many known items
    these are dealt into slices. Pairs with an item of more than ``rows`` features are expanded and probed.
    """
    features = cut_lineage(item_features.select("item", "feature"))
    sizes = features.groupBy("item").agg(F.count("*").alias("n"))
    few = sizes.where(F.col("n") <= rows)
    packed = cut_lineage(features.join(few, "item").groupBy("item").agg(F.first("n").alias("n"), F.collect_list("feature").alias("m")))
    wanted = cut_lineage(candidates.select("context", "item").distinct())
    known = truth.join(wanted.select("context").distinct(), "context", "left_semi").select("context", F.col("item").alias("known"))
    slices = known.groupBy("context").agg(F.ceil(F.count("*") / rows).cast("int").alias("slices"))
    known = cut_lineage(known.join(slices, "context"))
    many = features.select("item").join(few, "item", "left_anti").distinct()

    def with_members(df: DataFrame, end: str, n: str, m: str) -> DataFrame:
        held = df.join(packed.select(F.col("item").alias(end), F.col("n").alias(n), F.col("m").alias(m)), end, "left")
        return held.withColumns({n: F.coalesce(n, F.lit(0).cast("bigint")), m: F.coalesce(m, F.array().cast(packed.schema["m"].dataType))})

    left = with_members(wanted.join(slices, "context"), "item", "size_a", "x").withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    right = with_members(known, "known", "size_b", "y").withColumn("slice", F.pmod(F.xxhash64("known"), F.col("slices")).cast("int")).drop("slices")
    large = not many.isEmpty()
    if large:
        left, right = (df.join(many.select(F.col("item").alias(end)), end, "left_anti") for df, end in ((left, "item"), (right, "known")))
    shared = F.size(F.array_intersect("x", "y")).cast("bigint")
    scored = left.join(right, ["context", "slice"]).where(F.col("item") != F.col("known")).select(
        "context", "item", "known", F.round(jaccard_of(shared, F.col("size_a"), F.col("size_b")), digits).alias("similarity"))
    if large:
        pairs = wanted.join(known.drop("slices"), "context").where(F.col("item") != F.col("known"))
        far = pairs.join(many.withColumn("__a", F.lit(1)), "item", "left").join(many.select(F.col("item").alias("known"), F.lit(1).alias("__b")), "known", "left")
        far = far.where(F.col("__a").isNotNull() | F.col("__b").isNotNull()).select("context", "item", "known")
        other = features.select(F.col("item").alias("known"), "feature")
        of_pairs = pair_jaccard(far.select("item", "known").distinct(), features, other, "item", "known", "similarity", digits)
        scored = scored.unionByName(far.join(of_pairs, ["item", "known"]).select("context", "item", "known", "similarity"))
    s = F.col("similarity")
    return scored.groupBy("context", "item").agg(
        F.max("similarity").alias("best"),
        F.max_by("known", F.struct(s, (-F.col("known")).alias("tie"))).alias("best_match"),
        F.count_if(s > 0.7).alias("above_70"),
        F.count_if(s > 0.5).alias("above_50"),
    )


def items_above(vectors: DataFrame, truth: DataFrame, floor: float) -> DataFrame:
    """(context, item): items that are true for a training context with a cosine of at least ``floor``."""
    held = truth.select(F.col("context").alias("id"), F.col("item").alias("label"))
    points = as_points(vectors)
    return labels_above(points, points, held, floor).select(F.col("q_id").alias("context"), F.col("label").alias("item"))


def class_coherence(candidates: DataFrame, vectors: DataFrame, truth: DataFrame, classes: DataFrame, floor: float = 0.7) -> DataFrame:
    """Share of class-mates true for a similar context, counted per (context, class); -1 without mates.

    Of an item in several classes the best share counts.
    """
    hits = cut_lineage(items_above(vectors, truth, floor))
    per_class = hits.join(classes, "item").groupBy("context", "cls").agg(F.count("*").alias("n_hit"))
    sizes = classes.groupBy("cls").agg(F.countDistinct("item").alias("n_class"))
    own = hits.withColumn("own", F.lit(1))
    return (
        candidates.join(classes, "item").join(sizes, "cls")
        .join(per_class, ["context", "cls"], "left").join(own, ["context", "item"], "left")
        .select(
            "context", "item",
            F.when(F.col("n_class") <= 1, F.lit(-1.0)).otherwise(
                F.round((F.coalesce("n_hit", F.lit(0)) - F.coalesce("own", F.lit(0))) / (F.col("n_class") - 1), 6)
            ).alias("coherence"),
        )
        .groupBy("context", "item").agg(F.max("coherence").alias("coherence"))
    )


def cross_category_boost(votes: DataFrame, truth: DataFrame, categories: DataFrame, at_least: int, factor: float) -> DataFrame:
    """Items true in several categories get their score multiplied."""
    width = truth.join(categories, "context").groupBy("item").agg(F.countDistinct("category").alias("__n"))
    boosted = F.when(F.col("__n") >= at_least, F.col("score") * factor).otherwise(F.col("score"))
    return votes.join(width, "item", "left").select("context", "item", F.round(boosted, 9).alias("score"))


def dominant_class_boost(votes: DataFrame, classes: DataFrame, top: int = 3, boost: float = 0.5) -> DataFrame:
    """Boost items of the classes that are most frequent in the pool of the query (any class of an item counts)."""
    labelled = votes.join(classes, "item", "left")
    pool = labelled.where(F.col("cls").isNotNull()).groupBy("context", "cls").agg(F.count("*").alias("n"))
    dominant = top_n(pool, ["context"], "n", "cls", top, "r").select("context", "cls", F.lit(1).alias("__d"))
    rows = labelled.join(dominant, ["context", "cls"], "left").groupBy("context", "item").agg(
        F.max("score").alias("score"), F.max("__d").alias("__d")
    )
    factor = F.when(F.col("__d").isNull(), 1.0).otherwise(1.0 + boost)
    return rows.select("context", "item", F.round(F.col("score") * factor, 9).alias("score"))


def _to_others(pairs: DataFrame, group: str, member: str) -> DataFrame:
    """Max and mean cosine of each member to the other members of its group.

    The maximum is a nearest-neighbour join inside the group, the mean comes from the sum of
    the unit vectors; the pairs of a group are never listed.
    """
    points = pairs.select(F.col(member).alias("id"), F.col(group), "vec")
    best = nearest_vectors(points, points, 1, by=[group], exclude_self=True, names=(member, "__o", "mx"), digits=12)
    unit = F.transform("vec", lambda x: F.when(F.col("size") > 0, x / F.col("size")).otherwise(0.0))
    units = pairs.withColumn("size", V.norm(F.col("vec"))).select(group, member, unit.alias("unit"))
    sums = (
        units.select(group, F.posexplode("unit").alias("pos", "x")).groupBy(group, "pos")
        .agg(F.sum("x").alias("x"), F.count("*").alias("n"))
        .groupBy(group).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s.x).alias("total"),
            F.max("n").alias("n"),
        )
    )
    mean = units.join(sums, group).where(F.col("n") > 1).select(
        group, member,
        ((V.dot(F.col("unit"), F.col("total")) - V.dot(F.col("unit"), F.col("unit"))) / (F.col("n") - 1)).alias("av"),
    )
    return best.select(group, member, "mx").join(mean, [group, member])


def similarity_to_known(truth: DataFrame, vectors: DataFrame, item_vectors: DataFrame, digits: int = 6) -> DataFrame:
    """Max and mean similarity of an item to the known items, and of a context to the known contexts."""
    c = vectors.select("context", V.doubles(F.col("vec")).alias("cv"))
    i = item_vectors.select("item", V.doubles(F.col("vec")).alias("iv"))
    pairs = truth.join(c, "context").join(i, "item")
    by_item = _to_others(pairs.select("context", "item", F.col("iv").alias("vec")), "context", "item")
    by_context = _to_others(pairs.select("context", "item", F.col("cv").alias("vec")), "item", "context")
    zero = F.lit(0.0)

    def named(df, what):
        return df.select("context", "item", F.col("mx").alias(f"mx_{what}"), F.col("av").alias(f"av_{what}"))

    return (
        pairs.select("context", "item")
        .join(named(by_item, "item"), ["context", "item"], "left")
        .join(named(by_context, "context"), ["context", "item"], "left")
        .select(
            "context", "item",
            *[F.round(F.coalesce(f"{s}_{w}", zero), digits).alias(f"{long}_{w}")
              for w in ("item", "context") for s, long in (("mx", "max"), ("av", "mean"))],
        )
    )
