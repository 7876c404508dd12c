"""N: name matching. Substring matches are equi joins on a shared character gram."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.session import cut_lineage


def _grams(df: DataFrame, column: str, q: int, keep: Sequence[str], short: bool) -> DataFrame:
    length = F.length(column)
    sizes = F.filter(F.sequence(F.lit(1 if short else q), F.lit(q)), lambda n: n <= length)
    grams = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), length - n + 1), lambda i: F.substring(F.col(column), i, n))))
    return df.where(length >= (1 if short else q)).select(*keep, column, F.explode(F.array_distinct(grams)).alias("gram"))


def anchored(texts: DataFrame, text: str, needles: DataFrame, needle: str, q: int = 3, short: bool = False) -> DataFrame:
    """(text, needle) of distinct strings that share the needle's anchor: its gram that fewest texts (then fewest needles) hold."""
    n_grams = _grams(needles, needle, q, [], short).where(F.length("gram") == F.least(F.length(needle), F.lit(q)))
    counts = n_grams.groupBy("gram").agg(F.count("*").alias("__n"))
    t_grams = _grams(texts, text, q, [], short)
    held = t_grams.join(counts, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("__t"))
    # a needle with a gram that no text holds is in none: it needs no anchor
    anchors = (
        n_grams.join(counts, "gram").join(held, "gram", "left").groupBy(needle)
        .agg(F.min_by("gram", F.struct("__t", "__n", "gram")).alias("gram"), F.count_if(F.col("__t").isNull()).alias("__none"))
        .where("__none = 0").select(needle, "gram")
    )
    return t_grams.join(anchors, "gram").select(text, needle)


def contains_join(texts: DataFrame, text: str, needles: DataFrame, needle: str, q: int = 3, short: bool = False) -> DataFrame:
    """All (text, needle) pairs where the text contains the needle, exact for needles of q characters
    or more (``short``: for any length).

    Every text that holds a needle also holds each of its grams, so each needle is filed under its
    anchor gram and the texts meet it by an equi join on that gram; ``contains`` confirms. Both
    inputs are reduced to distinct strings first.
    """
    met = anchored(texts.select(text).distinct(), text, needles.select(needle).distinct(), needle, q, short)
    return met.where(F.contains(text, needle))


def either_contains(a: DataFrame, x: str, b: DataFrame, y: str, q: int, short: bool = False) -> DataFrame:
    """Pairs where one string holds the other, in either direction."""
    return contains_join(a, x, b, y, q, short).unionByName(contains_join(b, y, a, x, q, short)).distinct()


def synonym_table(spark: SparkSession, synonyms: Mapping[str, str]) -> DataFrame:
    """(place, synonym, canonical) in the order of the mapping."""
    return spark.createDataFrame([(i, s, c) for i, (s, c) in enumerate(synonyms.items())], "place long, synonym string, canonical string")


def canonical(names: DataFrame, column: str, synonyms: DataFrame, min_length: int = 6) -> DataFrame:
    """(column, canon) for every distinct name: an exact synonym's canonical form; else that of the first synonym (by
    place) inside the name or around it, both of ``min_length`` characters or more; else the name.

    ``synonyms`` (place, synonym, canonical) may be of any size: names meet it by equi joins, first on the whole name, then
    on the anchor grams of ``contains_join``, and the table's order travels as ``place``. A null name has a null form.
    """
    table = synonyms.where("synonym is not null").groupBy("synonym").agg(F.min_by("canonical", "place").alias("c"), F.min("place").alias("place"))
    todo = names.select(column).distinct()
    first = todo.join(table.select(F.col("synonym").alias(column), F.col("c").alias("__exact")), column, "left")
    rest = first.where(F.col("__exact").isNull() & (F.length(column) >= min_length)).select(column)
    long = table.where(F.length("synonym") >= min_length).select("synonym", "c", "place")
    loose = (
        either_contains(rest, column, long.select("synonym"), "synonym", min_length).join(long, "synonym")
        .groupBy(column).agg(F.min_by("c", "place").alias("__loose"))
    )
    return first.join(loose, column, "left").select(column, F.coalesce("__exact", "__loose", column).alias("canon"))


def cascade_match(names: DataFrame, mapped: DataFrame, synonyms: Mapping[str, str] | DataFrame, min_name: int = 21, min_mapped: int = 11) -> DataFrame:
    """Exact normalised name, then canonical name, then a long substring; ties to the lowest id or name.

    ``names`` (name) and ``mapped`` (name, id) -> (name, id, step); synonyms as a mapping or as the table of ``canonical``.
    """
    norm = T.normal_context_name(F.col("name"))
    table = synonyms if isinstance(synonyms, DataFrame) else synonym_table(names.sparkSession, synonyms)
    todo = names.select("name").distinct().withColumn("norm", norm)
    known = mapped.select(norm.alias("m_norm"), "id").groupBy("m_norm").agg(F.min("id").alias("id"))
    forms = cut_lineage(canonical(todo.select("norm").unionByName(known.select(F.col("m_norm").alias("norm"))), "norm", table))  # read twice
    todo = todo.join(forms, "norm", "left")
    by_canon = known.join(forms.select(F.col("norm").alias("m_norm"), F.col("canon").alias("m_canon")), "m_norm").groupBy("m_canon").agg(F.min("id").alias("id2"))
    first = todo.join(known.withColumnRenamed("id", "id1"), F.col("norm") == F.col("m_norm"), "left").join(
        by_canon, F.col("canon") == F.col("m_canon"), "left"
    )
    rest = first.where(F.col("id1").isNull() & F.col("id2").isNull() & (F.length("norm") >= min_name)).select("norm").distinct()
    long = known.where(F.length("m_norm") >= min_mapped)
    loose = either_contains(rest, "norm", long.select("m_norm"), "m_norm", min_mapped)
    found = loose.groupBy("norm").agg(F.min("m_norm").alias("m_norm")).join(known.withColumnRenamed("id", "id3"), "m_norm").select("norm", "id3")
    out = first.drop("m_norm", "m_canon").join(found, "norm", "left")
    step = F.when(F.col("id1").isNotNull(), 1).when(F.col("id2").isNotNull(), 2).when(F.col("id3").isNotNull(), 4)
    return out.select("name", F.coalesce("id1", "id2", "id3").alias("id"), step.alias("step"))


def coverage(matches: DataFrame, samples: int = 50) -> DataFrame:
    """Totals, rate and the first unmapped names."""
    first = matches.where(F.col("id").isNull()).select("name").orderBy("name").limit(samples).agg(
        F.concat_ws("|", F.array_sort(F.collect_list("name"))).alias("unmapped_names")
    )
    one = matches.agg(F.count("*").alias("total"), F.count("id").alias("mapped"))
    return one.join(F.broadcast(first)).select(
        "total", "mapped", (F.col("total") - F.col("mapped")).alias("unmapped"),
        F.round(F.col("mapped") / F.col("total"), 6).alias("rate"), "unmapped_names",
    )


def salt_fallback(names: DataFrame, known: DataFrame, salts: Sequence[str]) -> DataFrame:
    """Unknown names lose the listed salts one after the other until the rest is known.

    The stripped forms are columns of the same row; one equi join finds the first known form.
    """
    low = F.lower("name")
    forms = [low]
    for salt in salts:
        forms.append(F.replace(forms[-1], F.lit(salt), F.lit("")))
    tries = names.select("name").distinct().select("name", F.posexplode(F.transform(F.array(*forms), lambda f: F.trim(f))).alias("ord", "form"))
    hit = tries.join(known.select(F.lower("name").alias("form"), "id"), "form").groupBy("name").agg(F.min_by("id", F.struct("ord", "id")).alias("id"))
    return names.select("name").distinct().join(hit, "name", "left")


def search(names: DataFrame, column: str, id_col: str, words: Sequence[str], n: int) -> DataFrame:
    """First n rows per search word whose name holds the word or is held by it."""
    w = F.explode(F.array(*[F.lit(x.lower()) for x in words])).alias("word")
    low = F.lower(column)
    hits = names.select(id_col, column, w).where(F.contains(low, F.col("word")) | F.contains(F.col("word"), low))
    order = Window.partitionBy("word").orderBy(column, id_col)
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def resolve_mentions(mentions: DataFrame, entities: DataFrame, q: int = 3) -> DataFrame:
    """Exact lower-case name, else the lowest name that partly matches in either direction.

    ``mentions`` (mention), ``entities`` (name, id) -> (mention, id, how).
    """
    m = mentions.select("mention", F.lower("mention").alias("low")).distinct()
    e = entities.select(F.lower("name").alias("e_low"), "id").groupBy("e_low").agg(F.min("id").alias("id"))
    exact = m.join(e, F.col("low") == F.col("e_low"), "left")
    rest = exact.where(F.col("id").isNull()).select("low").distinct()
    loose = either_contains(rest, "low", e.select("e_low"), "e_low", q, short=True).groupBy("low").agg(F.min("e_low").alias("e2"))
    part = loose.join(e.select(F.col("e_low").alias("e2"), F.col("id").alias("id2")), "e2").select("low", "id2")
    out = exact.join(part, "low", "left")
    how = F.when(F.col("id").isNotNull(), F.lit("exact")).when(F.col("id2").isNotNull(), F.lit("partial")).otherwise(F.lit("none"))
    return out.select("mention", F.coalesce("id", "id2").alias("id"), how.alias("how"))


def with_aliases(names: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Alias -> id of the official name, where the official exists and the alias does not."""
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(o).alias("official")) for a, o in aliases.items()])).alias("r")
    table = names.sparkSession.range(1).select(rows).select("r.*")
    known = names.select(F.lower("name").alias("low"), "id").groupBy("low").agg(F.min("id").alias("id"))
    added = (
        table.join(known, F.col("official") == F.col("low")).select("alias", "id")
        .join(known.select(F.col("low").alias("alias")), "alias", "left_anti")
    )
    return known.select(F.col("low").alias("name"), "id").unionByName(added.select(F.col("alias").alias("name"), "id"))


def proper_name(c: Column, code_patterns: Sequence[str], max_length: int = 50) -> Column:
    """No code pattern, at least one letter, not too long."""
    bad = F.lit(False)
    for p in code_patterns:
        bad = bad | c.rlike("(?i)" + p)
    return ~bad & c.rlike("[a-zA-Z]") & (F.length(c) <= max_length)


def rank_text(c: Column) -> tuple[Column, Column]:
    """Best and median rank of a ``{name: rank}`` text."""
    ranks = F.array_sort(F.map_values(F.from_json(F.replace(c, F.lit("'"), F.lit('"')), "map<string,int>")))
    n = F.size(ranks)
    low, high = F.get(ranks, F.floor((n - 1) / 2).cast("int")), F.get(ranks, F.floor(n / 2).cast("int"))
    return F.array_min(ranks), (low + high) / 2


def find_by_alternatives(queries: DataFrame, nodes: DataFrame, q: int = 3) -> DataFrame:
    """The node for the first alternative that equals a name, else is part of one.

    ``queries`` (query, alternatives array), ``nodes`` (id, name).
    """
    alt = queries.select("query", F.posexplode("alternatives").alias("ord", "alt")).withColumn("alt", F.lower("alt"))
    low = nodes.select("id", F.lower("name").alias("low"))
    best = low.groupBy("low").agg(F.min("id").alias("id"))
    pairs = contains_join(best, "low", alt, "alt", q, short=True).join(best, "low")
    scored = alt.join(pairs, "alt").groupBy("query").agg(
        F.min_by(F.struct("id", "low", "alt"), F.struct("ord", (F.col("low") != F.col("alt")).alias("partial"), "low")).alias("r")
    )
    return scored.select("query", "r.id", F.col("r.low").alias("name"), F.col("r.alt").alias("matched"))


def symbols_to_ids(listed: DataFrame, lookup: DataFrame) -> DataFrame:
    """Symbols in any case to ids, unknown symbols dropped."""
    return listed.select(F.upper("symbol").alias("symbol")).distinct().join(lookup.withColumn("symbol", F.upper("symbol")), "symbol")


def term_pairs(names: DataFrame, terms: DataFrame, q: int = 5) -> DataFrame:
    """Candidate pairs (a, b) for the loose and strict matches: a shared word, or one inside the other.

    Both matches need one of these, so nothing is lost and no cross product is formed.
    """
    a = names.select("a").distinct()
    b = terms.select("b").distinct()
    low_a, low_b = a.withColumn("x", F.lower("a")), b.withColumn("y", F.lower("b"))
    wa = low_a.select("a", F.explode(F.array_distinct(T.significant_words(F.col("a")))).alias("w"))
    wb = low_b.select("b", F.explode(F.array_distinct(T.significant_words(F.col("b")))).alias("w"))
    by_word = wa.join(wb, "w").select("a", "b").distinct()
    inside = either_contains(low_a, "x", low_b, "y", q).join(low_a, "x").join(low_b, "y").select("a", "b")
    equal = low_a.join(low_b, F.col("x") == F.col("y")).select("a", "b")
    return by_word.unionByName(inside).unionByName(equal).distinct()
