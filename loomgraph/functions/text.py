"""String functions used by the matching and rule operators (all Column -> Column)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Salt words that name matching removes, in the order of removal.
SALT_WORDS = (
    " hydrochloride", " hcl", " sodium", " potassium", " acetate", " sulfate", " citrate",
    " maleate", " mesylate", " tartrate", " phosphate", " fumarate", " succinate", " besylate",
    " dihydrate", " monohydrate",
)

# Words that carry no meaning in the loose term match.
LOOSE_STOP_WORDS = (
    "of", "the", "and", "or", "in", "a", "an", "with", "type", "nos", "unspecified", "other",
    "acute", "chronic", "severe", "mild", "moderate", "disorder", "disease", "syndrome",
    "condition",
)

# Ordered patterns that pull a base id out of a prefixed id.
BASE_ID_PATTERNS = (
    r"Gene::(\d+)",
    r"Compound::(DB\d+)",
    r"Compound::hmdb:(HMDB\d+)",
    r"hetionet:(\d+)",
    r"hetionet:(DB\d+)",
    r"primekg:gene/protein:(\d+)",
    r"primekg:drug:(DB\d+)",
    r"::(C\d+)",
)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def any_of(words: Iterable[str]) -> str:
    """Alternation pattern of literal words (one scan of the text for the whole list)."""
    return "(" + "|".join(re.escape(w) for w in words) + ")"


def contains_any(c: Column, words: Iterable[str]) -> Column:
    words = list(words)
    return c.rlike(any_of(words)) if words else F.lit(False)


def has_word(c: Column, words: Iterable[str]) -> Column:
    words = list(words)
    return c.rlike(r"\b" + any_of(words) + r"\b") if words else F.lit(False)


def normal_context_name(c: Column) -> Column:
    """Lower case, trimmed, possessives folded, ``-_`` as blanks, no trailing punctuation."""
    c = F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")
    c = F.replace(F.replace(c, F.lit("'s"), F.lit("s")), F.lit("'"), F.lit(""))
    c = F.regexp_replace(F.regexp_replace(c, "[-_]", " "), r"\s+", " ")
    return F.regexp_replace(c, "[.,;:]+$", "")


def drop_salts(c: Column, salts: Iterable[str] = SALT_WORDS) -> Column:
    for salt in salts:
        c = F.replace(c, F.lit(salt), F.lit(""))
    return c


def normal_item_name(c: Column, salts: Iterable[str] = SALT_WORDS) -> Column:
    """Salts and bracketed parts removed, then letters and digits only."""
    c = drop_salts(F.trim(F.lower(c)), salts)
    return F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", ""), "[^a-z0-9]", "")


def plain_id(c: Column) -> Column:
    """Id without graph and type prefixes."""
    return F.regexp_replace(
        F.regexp_replace(c, "^drkg:", ""), "^(Compound::|Disease::|Gene::)(MESH:|DOID:)?", ""
    )


def base_id(c: Column, patterns: Iterable[str] = BASE_ID_PATTERNS) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns])


def significant_words(c: Column, stop: Iterable[str] = LOOSE_STOP_WORDS) -> Column:
    words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    return F.array_except(words, F.array(*[F.lit(w) for w in stop]))


def loose_match(a: Column, b: Column) -> Column:
    """Equal, one inside the other (5 characters or more), or all significant words shared."""
    a, b = F.lower(a), F.lower(b)
    wa, wb = significant_words(a), significant_words(b)
    shared = F.size(F.array_intersect(wa, wb))
    return (
        (a == b)
        | ((F.length(b) >= 5) & F.contains(a, b))
        | ((F.length(a) >= 5) & F.contains(b, a))
        | (
            (F.size(wa) > 0)
            & (F.size(wb) > 0)
            & (shared > 0)
            & (shared >= F.least(F.size(wa), F.size(wb)))
        )
    )


def _as_words(c: Column) -> Column:
    return F.concat(F.lit(" "), F.regexp_replace(c, "[^a-z0-9_]+", " "), F.lit(" "))


def strict_match(a: Column, b: Column, generic: Iterable[str] = ()) -> Column:
    """Equal, or a whole phrase of the other (8 characters or more); generic terms never match."""
    a, b = F.lower(a), F.lower(b)
    pa, pb = _as_words(a), _as_words(b)
    hit = (
        (a == b)
        | ((F.length(b) >= 8) & F.contains(pa, pb))
        | ((F.length(a) >= 8) & F.contains(pb, pa))
    )
    generic = list(generic)
    return hit & ~b.isin(generic) if generic else hit
