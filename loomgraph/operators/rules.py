"""P: ordered rules as data. One list of rules gives the winner, the audit and the what-if run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators.ranking import tier_order

TIERS = ("GOLDEN", "HIGH", "MEDIUM", "LOW", "FILTER")


@dataclass(frozen=True)
class Rule:
    """A named condition with its value; the place in the list is its priority."""

    name: str | Column | None
    condition: Column
    value: str | Column

    def outcome(self) -> Column:
        name = self.name if isinstance(self.name, Column) else F.lit(self.name).cast("string")
        value = self.value if isinstance(self.value, Column) else F.lit(self.value)
        return F.struct(value.alias("tier"), name.alias("rule"))


def first_match(rules: Sequence[Rule], default: str | None = None) -> Column:
    """Outcome struct (tier, rule) of the first rule that holds."""
    out = None
    for r in rules:
        out = F.when(r.condition, r.outcome()) if out is None else out.when(r.condition, r.outcome())
    fallback = F.struct(F.lit(default).alias("tier"), F.lit(None).cast("string").alias("rule"))
    return out.otherwise(fallback) if default is not None else out


def all_matches(rules: Sequence[Rule]) -> Column:
    """P20: all rules that hold, in order, as (ord, tier, rule)."""
    rows = [
        F.struct(F.lit(i).alias("ord"), r.outcome().getField("tier").alias("tier"), r.outcome().getField("rule").alias("rule"),
                 F.coalesce(r.condition, F.lit(False)).alias("holds"))
        for i, r in enumerate(rules)
    ]
    return F.filter(F.array(*rows), lambda x: x.holds)


def keyword_category(c: Column, keywords: Mapping[str, Sequence[str]], default: str = "other") -> Column:
    """First category, in order, one of whose words is part of the name."""
    out = None
    for cat, words in keywords.items():
        hit = T.contains_any(F.lower(c), words)
        out = F.when(hit, F.lit(cat)) if out is None else out.when(hit, F.lit(cat))
    return out.otherwise(F.lit(default))


def keyword_categories(c: Column, keywords: Mapping[str, Sequence[str]], default: str = "other") -> Column:
    """All matching categories."""
    hits = F.array_compact(F.array(*[F.when(T.contains_any(F.lower(c), w), F.lit(k)) for k, w in keywords.items()]))
    return F.when(F.size(hits) > 0, F.array_sort(hits)).otherwise(F.array(F.lit(default)))


def pattern_type(c: Column, patterns: Sequence[tuple[str, str]], default: str) -> Column:
    """First type whose pattern matches."""
    out = None
    for name, p in patterns:
        hit = F.lower(c).rlike(p)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(default))


def word_types(c: Column, types: Mapping[str, Sequence[str]], short: int = 4) -> Column:
    """All types whose keyword occurs; keywords of up to ``short`` letters only as a whole word."""
    low = F.lower(c)

    def hit(words):
        whole = [w for w in words if len(w) <= short]
        part = [w for w in words if len(w) > short]
        return T.contains_any(low, part) | T.has_word(low, whole)

    return F.array_compact(F.array(*[F.when(hit(w), F.lit(k)) for k, w in types.items()]))


def type_match(pairs: DataFrame, truth: DataFrame, context_types: DataFrame) -> DataFrame:
    """Has the item truth of any type, and of a type of the context?  ``context_types`` (context, type) is long."""
    item_types = truth.join(context_types, "context").select("item", "type").distinct()
    any_type = item_types.select("item").distinct().withColumn("has_type", F.lit(True))
    same = (
        pairs.select("context", "item").join(context_types, "context").join(item_types, ["item", "type"], "left_semi")
        .select("context", "item").distinct().withColumn("same_type", F.lit(True))
    )
    no = F.lit(False)
    return (
        pairs.join(any_type, "item", "left").join(same, ["context", "item"], "left")
        .withColumn("has_type", F.coalesce("has_type", no)).withColumn("same_type", F.coalesce("same_type", no))
    )


def hierarchy_group(name: Column, category: Column | None, groups: Mapping[str, Mapping[str, Sequence[str]]], exclusions: Mapping[tuple[str, str], Sequence[str]]) -> Column:
    """P5: groups (category, group) whose variant is part of the name or holds it, exclusions first; array in order."""
    low = F.lower(name)
    rows = []
    for cat, gs in groups.items():
        for g, variants in gs.items():
            hit = T.contains_any(low, variants)
            for v in variants:
                hit = hit | F.contains(F.lit(v), low)
            veto = exclusions.get((cat, g), ())
            if veto:
                hit = hit & ~T.contains_any(low, veto)
            if category is not None:
                hit = hit & (category == cat)
            rows.append(F.when(hit, F.struct(F.lit(cat).alias("category"), F.lit(g).alias("grp"))))
    return F.array_compact(F.array(*rows))


def group_match(pairs: DataFrame, truth: DataFrame, contexts: DataFrame, groups, exclusions) -> DataFrame:
    """P5: does the item hold truth in the group of the context?  Adds ``grp`` (null without a match)."""
    named = contexts.select("context", "name", "category")
    of_truth = (
        truth.join(named.select("context", F.explode(hierarchy_group(F.col("name"), None, groups, exclusions)).alias("g")), "context")
        .select("item", F.col("g.category").alias("category"), F.col("g.grp").alias("grp")).distinct()
    )
    own = F.get(hierarchy_group(F.col("name"), F.col("category"), groups, exclusions), 0).getField("grp")
    target = named.select("context", "category", own.alias("grp")).where(F.col("grp").isNotNull())
    hit = pairs.select("context", "item").join(target, "context").join(of_truth, ["item", "category", "grp"], "left_semi")
    return pairs.join(hit.select("context", "item", "grp").distinct(), ["context", "item"], "left")


def biologic_check(df: DataFrame, suffix: str, infixes: Mapping[str, str], known: Mapping[str, str], compatible: Mapping[str, Sequence[str]]) -> DataFrame:
    """Target by the known table, else by an infix in the last six letters before the suffix."""
    low = F.lower("name")
    stem = F.substring(low, F.greatest(F.length(low) - len(suffix) - 5, F.lit(1)), F.least(F.lit(6), F.length(low) - len(suffix)))
    infix = None
    for i, target in infixes.items():
        infix = F.when(F.contains(stem, F.lit(i)), F.lit(target)) if infix is None else infix.when(F.contains(stem, F.lit(i)), F.lit(target))
    infix = F.when(F.endswith(low, F.lit(suffix)), F.coalesce(infix, F.lit("unknown")))
    named = None
    for n, target in known.items():
        named = F.when(low == n, F.lit(target)) if named is None else named.when(low == n, F.lit(target))
    target = F.coalesce(named, infix) if named is not None else infix
    ok = F.lit(False)
    for tgt, cats in compatible.items():
        ok = ok | ((F.col("target") == tgt) & F.col("category").isin(*cats))
    return df.withColumn("target", target).withColumn("compatible", F.col("target").isNull() | ok)


def base_and_complication(pairs: DataFrame, truth_names: DataFrame, complications: Mapping[str, Sequence[str]], scores: Mapping[str, float], exclusions: Mapping[str, Sequence[str]] = {}) -> DataFrame:
    """``base_to_comp`` (item treats the base, pair is its complication) and ``transfer`` (the reverse).

    ``pairs`` and ``truth_names`` hold (item, context_name).  The base and complication words of
    the truth are flags per item, so the check is one join on the item.
    """
    low = F.lower("context_name")
    flags = []
    for b in complications:
        flags.append(F.bool_or(F.contains(low, F.lit(b.lower()))).alias(f"base_{b}"))
    for c in scores:
        flags.append(F.bool_or(F.contains(low, F.lit(c.lower()))).alias(f"comp_{c}"))
    treated = truth_names.groupBy("item").agg(*flags)
    out = pairs.join(treated, "item", "left")
    to_comp, transfer = F.lit(False), None
    for b, comps in complications.items():
        is_comp = F.lit(False)
        for c in comps:
            is_comp = is_comp | (low == c.lower()) | F.startswith(low, F.lit(c.lower() + " "))
        to_comp = to_comp | (F.coalesce(F.col(f"`base_{b}`"), F.lit(False)) & is_comp)
    for c, s in scores.items():
        for b, comps in complications.items():
            if c.lower() in [x.lower() for x in comps]:
                hit = F.coalesce(F.col(f"`comp_{c}`"), F.lit(False)) & (F.contains(low, F.lit(b.lower())) | F.contains(F.lit(b.lower()), low))
                if exclusions.get(b):
                    hit = hit & ~T.contains_any(low, exclusions[b])
                transfer = F.when(hit, F.lit(float(s))) if transfer is None else transfer.when(hit, F.lit(float(s)))
    keep = pairs.columns
    return out.select(*keep, to_comp.alias("base_to_comp"), (transfer if transfer is not None else F.lit(None)).alias("transfer"))


def isolated_items(truth: DataFrame, categories: DataFrame) -> DataFrame:
    """Items true in exactly one category."""
    return truth.join(categories, "context").groupBy("item").agg(
        F.countDistinct("category").alias("n"), F.min("category").alias("only_category")
    ).where(F.col("n") == 1).select("item", "only_category")


def broad_class(name: Column, classes: Mapping[str, Sequence[str]]) -> Column:
    out = None
    for cls, words in classes.items():
        hit = T.contains_any(F.lower(name), words)
        out = F.when(hit, F.lit(cls)) if out is None else out.when(hit, F.lit(cls))
    return out


def broad_class_isolated(df: DataFrame, classes: Mapping[str, Sequence[str]], by: Sequence[str] = ("context",)) -> DataFrame:
    """Items of a broad class whose class has no other name among the predictions of the context."""
    low = F.lower("item_name")
    tagged = df.withColumn("__cls", broad_class(F.col("item_name"), classes))
    members = tagged
    flags = F.array_compact(F.array(*[F.when(T.contains_any(low, w), F.lit(c)) for c, w in classes.items()]))
    mates = members.select(*by, F.explode(flags).alias("__cls"), low.alias("__low")).distinct().groupBy(*by, "__cls").agg(F.count("*").alias("__n"))
    return tagged.join(mates, [*by, "__cls"], "left").withColumn(
        "isolated", F.col("__cls").isNotNull() & (F.coalesce("__n", F.lit(0)) <= 1)
    ).drop("__n", "__cls")


def class_coherent(codes: Column, category: Column, expected: Mapping[str, Sequence[str]]) -> Column:
    """Is any code of the item in the set expected for the category?"""
    out = F.lit(False)
    for cat, wanted in expected.items():
        out = out | ((category == cat) & F.exists(codes, lambda x: x.isin(*wanted)))
    return out


def mismatch(code: Column, category: Column, zero_pairs: Sequence[tuple[str, str]]) -> Column:
    """The (code, category) pairs that never hit."""
    out = F.lit(False)
    for c, cat in zero_pairs:
        out = out | ((code == c) & (category == cat))
    return out


def activity_mismatch(item_name: Column, context_name: Column, activity: Mapping[str, Sequence[str]], needed: Mapping[str, str], exempt: Sequence[tuple[str, str]]) -> Column:
    """The item has known activities, the context needs one, and they differ; listed pairs are exempt."""
    have = F.array_compact(F.array(*[F.when(T.contains_any(F.lower(item_name), w), F.lit(a)) for a, w in activity.items()]))
    need = None
    for word, a in needed.items():
        hit = F.contains(F.lower(context_name), F.lit(word))
        need = F.when(hit, F.lit(a)) if need is None else need.when(hit, F.lit(a))
    free = F.lit(False)
    for i, c in exempt:
        free = free | ((F.lower(item_name) == i) & (F.lower(context_name) == c))
    return (F.size(have) > 0) & need.isNotNull() & ~F.array_contains(have, need) & ~free


@dataclass(frozen=True)
class Move:
    """A later change of the tier; ``rule`` None keeps the rule name."""

    condition: Column
    tier: str | None
    rule: str | None
    keep_rule: bool = False


def apply_moves(df: DataFrame, moves: Sequence[Move]) -> DataFrame:
    """Moves in order, each sees the tier and rule left by the one before."""
    for m in moves:
        hit = F.coalesce(m.condition, F.lit(False))
        rule = F.col("rule")
        if m.rule is not None:
            rule = F.coalesce("rule", F.lit(m.rule)) if m.keep_rule else F.lit(m.rule)
        df = df.withColumns({
            "tier": F.when(hit, F.lit(m.tier)).otherwise(F.col("tier")) if m.tier else F.col("tier"),
            "rule": F.when(hit, rule).otherwise(F.col("rule")),
        })
    return df


def literature_status(df: DataFrame, standard: Mapping[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """KNOWN_INDICATION, LIKELY_GT_GAP (item of a class that is standard for the category) or NOVEL.

    ``standard``: class -> (item word, categories); the row holds ``known``.
    """
    gap = None
    for cls, (word, cats) in standard.items():
        hit = F.contains(F.lower("item_name"), F.lit(word)) & F.col("category").isin(*cats)
        gap = F.when(hit, F.lit(cls)) if gap is None else gap.when(hit, F.lit(cls))
    cls = F.when(~F.col("known"), gap)
    status = F.when(F.col("known"), F.lit("KNOWN_INDICATION")).when(cls.isNotNull(), F.lit("LIKELY_GT_GAP")).otherwise(F.lit("NOVEL"))
    return df.withColumn("status", status).withColumn("standard_class", cls)


def inject_class_members(predictions: DataFrame, members: DataFrame, frequency: DataFrame, best: DataFrame, top_n: int) -> DataFrame:
    """Class members not yet predicted fill the list of their context up to ``top_n``.

    ``predictions`` (context, item, score, tier), ``members`` (context, item, item_name, cls),
    ``frequency`` (item, train_frequency), ``best`` (context, best_score).  Members come by
    frequency, then name; the list is re-ranked by tier, score and id.
    """
    size = predictions.groupBy("context").agg(F.count("*").alias("have"))
    new = (
        members.groupBy("context", "item").agg(F.min("item_name").alias("item_name"))
        .join(predictions.select("context", "item"), ["context", "item"], "left_anti")
        .join(frequency, "item", "left").withColumn("train_frequency", F.coalesce("train_frequency", F.lit(0)))
        .join(best, "context").join(size, "context", "left")
    )
    w = Window.partitionBy("context").orderBy(F.col("train_frequency").desc(), "item_name", "item")
    added = (
        new.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top_n - F.coalesce("have", F.lit(0)))
        .select("context", "item", F.round(F.col("best_score") * 0.5 * (1 + F.col("train_frequency") / 100), 6).alias("score"),
                F.lit("MEDIUM").alias("tier"), F.lit(True).alias("injected"))
    )
    old = predictions.select("context", "item", "score", "tier", F.lit(False).alias("injected"))
    order = Window.partitionBy("context").orderBy(tier_order(F.col("tier")), F.col("score").desc(), "item")
    return old.unionByName(added).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def specificity(name: Column, levels: Sequence[tuple[str, str, int, str]]) -> Column:
    """(category, group, level) of the first term that is part of the name."""
    out = None
    for cat, group, level, term in levels:
        value = F.struct(F.lit(cat).alias("category"), F.lit(group).alias("grp"), F.lit(level).alias("level"))
        hit = F.contains(F.lower(name), F.lit(term))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def depth_delta(pairs: DataFrame, truth: DataFrame, levels: DataFrame) -> DataFrame:
    """Level of the predicted context minus the deepest known level of the item in the same group."""
    known = truth.join(levels, "context").groupBy("item", "grp").agg(F.max("level").alias("known_level"))
    return pairs.join(levels, "context").join(known, ["item", "grp"]).withColumn("delta", F.col("level") - F.col("known_level"))


def in_lists(c: Column, lists: Mapping[str, tuple[str, Sequence[str]]]) -> dict[str, Column]:
    """P25: one flag per word list; mode ``equals``, ``contains`` or ``word``."""
    low = F.lower(c)
    test = {"equals": lambda w: low.isin(*w), "contains": lambda w: T.contains_any(low, w), "word": lambda w: T.has_word(low, w)}
    return {name: test[mode](list(words)) for name, (mode, words) in lists.items()}


def probability_band(p: Column, bands: Sequence[tuple[float, str]] = ((0.8, "Very High"), (0.6, "High"), (0.4, "Moderate"), (0.2, "Low")), default: str = "Very Low") -> Column:
    """P26."""
    out = None
    for floor, label in bands:
        out = F.when(p >= floor, F.lit(label)) if out is None else out.when(p >= floor, F.lit(label))
    return out.otherwise(F.lit(default))


def shifted_tier(tier: Column, step: Column, tiers: Sequence[str] = TIERS) -> Column:
    """``step`` tiers up (positive) or down, clamped."""
    at = tier_order(tier, tiers)
    to = F.greatest(F.lit(0), F.least(F.lit(len(tiers) - 1), at - step)).cast("int")
    return F.get(F.array(*[F.lit(t) for t in tiers]), to)
