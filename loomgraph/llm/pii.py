"""Personal data: fixed patterns, and terms that give a protected value away.

A value found by a pattern (an entity) is protected. How much a term in its documents discloses is the pointwise
mutual information of the two over the corpus, as a share of the entity's own information:
log(n_et N / (n_e n_t)) / log(N / n_e), with N distinct texts, n_t of them holding the term, n_e the entity and n_et
both. From a threshold on, and where the log-likelihood ratio of these counts rules out chance, the term is marked
wherever it stands in a text that holds the entity, and generalised or removed with it. There is no least number of
texts: of an entity that occurs once, terms that are rare enough disclose it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import pieces, texts
from loomgraph.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
_SLOTS = 1 << 24
_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# inside a run of digits no later start matches where the first fails
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"\w+(?:['’-]\w+)*")
SPAN = "array<struct<kind:string,start:long,end:long>>"


@dataclass(frozen=True)
class Settings:
    """threshold: least share of the entity's information; significance: least log-likelihood ratio of entity and term
    (10.83: one in a thousand by chance); broadcast_terms: most common terms that are left aside before the join, and
    up to so many groups of copies are broadcast, more are joined."""

    threshold: float = 0.8
    significance: float = 10.83
    broadcast_terms: int = 200_000


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address has one @, so a match is found at the first @ with a local part and a domain."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if local else None
        if domain:
            yield at - local, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start; per kind leftmost and without overlaps."""
    out = [("email", s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _NO_DIGIT.sub("", m[0])) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def entities(text: str, spans: list[tuple[str, int, int]]) -> list[str]:
    """The distinct protected values of a text."""
    return sorted({
        f"{kind}:{text[a:b].lower() if kind == 'email' else _NO_DIGIT.sub('' if kind != 'ip' else '.', text[a:b])}" for kind, a, b in spans
    })


def terms_of(text: str, spans: list[tuple[str, int, int]]) -> dict[str, list[dict]]:
    """All places of each word of the text, but of words that a span touches."""
    out: dict[str, list[dict]] = {}
    cuts = sorted((a, b) for _, a, b in spans)
    at = reach = 0  # reach: end of the spans that begin before the word's end
    for m in _WORD.finditer(text):
        while at < len(cuts) and cuts[at][0] < m.end():
            reach = max(reach, cuts[at][1])
            at += 1
        if m.end() - m.start() > 2 and reach <= m.start():
            out.setdefault(m[0].lower(), []).append({"start": m.start(), "end": m.end()})
    return out


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, spans, entities, text): base spans of every row; the text only where there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in pieces(batch):
                found = part["text"].to_pylist()
                spans = [base_spans(t) for t in found]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["text_id"],
                     pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in spans], span),
                     pa.array([entities(t, x) for t, x in zip(found, spans)], pa.list_(pa.string())),
                     pa.array([t if x else None for t, x in zip(found, spans)], pa.string())],
                    ["doc_id", "text_id", "spans", "entities", "text"],
                )

    source = texts(docs).withColumn("text_id", F.xxhash64("text"))
    return source.mapInArrow(
        run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text_id long, spans {SPAN}, entities array<string>, text string"
    )


def places(found: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(text_id, entity, n_e, term, at): words of each distinct text that holds an entity, with their places; n_e is
    the number of texts that hold the entity.

    Left aside are only words that can't reach the threshold whatever the counts: as n_et <= n_e, that
    needs n_t <= N^(1 - threshold) n_e^threshold, and the texts that hold an entity give n_t at least.
    """
    once = cut_lineage(found.where("text is not null").select("text_id", "text", "spans", "entities").dropDuplicates(["text_id"]))
    n = found.select("text_id").distinct().count()
    slack = n ** (1 - s.threshold) * (1 + 1e-9)
    each = once.select("text_id", F.explode("entities").alias("entity"))
    sizes = each.groupBy("entity").agg(F.count("*").alias("n_e"))
    held = each.join(sizes, "entity").groupBy("text_id").agg(F.collect_list(F.struct("entity", "n_e")).alias("held"))

    def found_terms(part: pa.RecordBatch) -> Iterator[dict[str, list[dict]]]:
        for text, spans in zip(part["text"].to_pylist(), part["spans"].to_pylist()):
            yield terms_of(text, [(x["kind"], x["start"], x["end"]) for x in spans])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "n"])

        for batch in batches:
            for part in pieces(batch):
                for terms in found_terms(part):
                    n.update(terms.keys())
                if len(n) > 500_000:
                    yield out()
                    n.clear()
        yield out()

    least = cut_lineage(once.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")))
    total = least.agg(F.sum("n")).first()[0] or 0
    # a word of more than total / k texts is one of k at most
    often = least.where(F.col("n") > max(slack, total / max(1, s.broadcast_terms)))
    sent = found.sparkSession.sparkContext.broadcast({r["term"]: r["n"] for r in often.collect()})
    threshold = s.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        known = sent.value
        for batch in batches:
            for part in pieces(batch):
                for text_id, held, terms in zip(part["text_id"].to_pylist(), part["held"].to_pylist(), found_terms(part)):
                    for x in held:
                        most = slack * x["n_e"] ** threshold
                        kept = [t for t in terms if known.get(t, 0) <= most]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([text_id] * len(kept), pa.int64()), pa.array([x["entity"]] * len(kept), pa.string()),
                             pa.array([x["n_e"]] * len(kept), pa.int64()), pa.array(kept, pa.string()), pa.array([terms[t] for t in kept], spot)],
                            ["text_id", "entity", "n_e", "term", "at"],
                        )

    return once.join(held, "text_id").select("text_id", "text", "spans", "held").mapInArrow(
        run, "text_id long, entity string, n_e long, term string, at array<struct<start:long,end:long>>"
    )


def _bitmap(terms: DataFrame) -> np.ndarray:
    """Which of the slots of term hashes are taken: a filter of fixed size that lets every one of the terms pass."""
    slot = F.pmod(F.xxhash64("term"), F.lit(_SLOTS))
    taken = (
        terms.select(F.floor(slot / 32).cast("int").alias("at"), F.pmod(slot, F.lit(32)).cast("int").alias("bit"))
        .groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()  # 2^19 rows at most
    )
    out = np.zeros(_SLOTS // 32, np.uint32)
    out[taken["at"].to_numpy()] = taken["bits"].to_numpy().astype(np.uint32)
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def document_counts(docs: DataFrame, terms: DataFrame, copies: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(term, n_t): distinct texts of the whole corpus that hold each of the terms, and of some other words.

    Tasks count their own documents first; each of the ``times`` rows of a text in ``copies`` (text_id, times) counts
    1 / times. Words outside a broadcast bitmap of the terms are left aside. Copies are broadcast if they are
    measured to be few; else rows meet their number of copies in a join.
    """
    source = texts(docs).withColumn("text_id", F.xxhash64("text"))
    if copies.limit(s.broadcast_terms + 1).count() <= s.broadcast_terms:
        known = {r["text_id"]: r["times"] for r in copies.collect()}
        source = source.select("text", "text_id", F.lit(1).cast("long").alias("times"))
    else:
        known = {}
        source = source.join(copies, "text_id", "left").select("text", "text_id", F.coalesce("times", F.lit(1)).cast("long").alias("times"))
    sent = docs.sparkSession.sparkContext.broadcast((_bitmap(terms), known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (taken, known), count, shares = sent.value, Counter(), Counter()

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([*count, *shares], pa.string()), pa.array([*count.values(), *shares.values()], pa.float64())], ["term", "n"]
            )

        for batch in batches:
            for part in pieces(batch):
                for text, text_id, times in zip(*(part[c].to_pylist() for c in ("text", "text_id", "times"))):
                    held = list(set(map(str.lower, set(_WORD.findall(text)))))
                    slots = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in held), np.uint64, len(held))
                    held = list(compress(held, taken[slots & np.uint64(_SLOTS - 1)].tolist()))
                    times = known.get(text_id, times)
                    if times == 1:
                        count.update(held)
                    else:
                        for term in held:
                            shares[term] += 1 / times
                if len(count) + len(shares) > 500_000:
                    yield out()
                    count.clear()
                    shares.clear()
        yield out()

    return source.mapInArrow(run, "term string, n double").groupBy("term").agg(F.round(F.sum("n")).cast("long").alias("n_t"))


def disclosing(docs: DataFrame, found: DataFrame, near: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(entity, term, share) of the terms that give an entity away. Copies of a text count once.

    ``near`` is places() of ``found``, which is scanned() of ``docs``.
    """
    copies = cut_lineage(found.groupBy("text_id").agg(F.count("*").alias("times")))
    n = copies.count()
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("n_et"), F.first("n_e").alias("n_e"))
    counts = document_counts(docs, near.select("term").distinct(), copies.where("times > 1"), s)
    counted = pairs.join(counts, "term").where(F.col("n_e") < n)
    both, of_e, of_t = F.col("n_et"), F.col("n_e"), F.col("n_t")
    share = F.log(both * F.lit(float(n)) / (of_e * of_t)) / F.log(n / of_e)

    def part(cell: Column, row: Column, column: Column) -> Column:
        return F.when(cell > 0, cell * F.log(cell * F.lit(float(n)) / (row * column))).otherwise(0.0)

    chance = 2 * (
        part(both, of_e, of_t) + part(of_e - both, of_e, n - of_t) + part(of_t - both, n - of_e, of_t)
        + part(n - of_e - of_t + both, n - of_e, n - of_t)
    )
    return counted.where((share >= s.threshold) & (chance >= s.significance)).select("entity", "term", share.alias("share"))


def spans(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, text_id, base, added) for every row: base spans, and spans of disclosing terms.

    Both are arrays of (kind, start, end) in code points of the text, end exclusive; ``added`` has
    kind "term" in order of start. A null text counts as empty and has none. Rows that repeat get
    the same spans each. text_id is a hash of the text.
    """
    found = cut_lineage(scanned(docs))
    near = cut_lineage(places(found, settings))
    told = disclosing(docs, found, near, settings)
    added = (
        near.join(told.select("entity", "term"), ["entity", "term"]).select("text_id", F.explode("at").alias("x"))
        .groupBy("text_id").agg(F.sort_array(F.collect_set("x")).alias("x"))
        .select("text_id", F.transform("x", lambda x: F.struct(F.lit(TERM).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("added"))
    )
    none = F.array().cast(SPAN)
    return (
        found.where("text is not null").join(added, "text_id", "left")
        .select("doc_id", "text_id", F.col("spans").alias("base"), F.coalesce("added", none).alias("added"))
        .unionByName(found.where("text is null").select("doc_id", "text_id", F.col("spans").alias("base"), none.alias("added")))
    )


def listed(spans: Column | str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count_of(kind: str, spans: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def _masked(text: str, marks: list[dict]) -> str:
    out, at = [], 0
    for m in sorted(marks, key=lambda m: (m["start"], -m["end"])):
        if m["start"] < at:
            continue
        word = text[m["start"] : m["end"]]
        general = m["kind"].upper() if m["kind"] != TERM else "NUMBER" if word[0].isdigit() else "NAME" if word[0].isupper() else ""
        out += [text[at : m["start"]], f"[{general}]" if general else ""]
        at = m["end"]
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, text): base spans become [KIND]; a disclosing number or name is generalised, another term removed."""
    marks = spans(docs, settings).where(F.size("base") > 0).select(
        F.col("doc_id").alias("_id"), F.col("text_id").alias("_text"), F.concat("base", "added").alias("marks")
    ).dropDuplicates(["_id", "_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [_masked(t, m) if m else t for t, m in zip(batch["text"].to_pylist(), batch["marks"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(text, pa.string())], ["doc_id", "text"])

    source = texts(docs).withColumn("text_id", F.xxhash64("text"))
    joined = source.join(marks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_id") == F.col("_text")), "left")
    return joined.select("doc_id", "text", "marks").mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string")
