"""Conversation repair by a generalised LR parser whose actions may also delete, rerole and insert turns.

The grammar of role initials is S -> (empty) | B | s B, B -> u a | B u a. Its LR tables are below. The
stacks of all parses form one graph: a node is a state and a link to the node beneath, equal nodes
are one, and reductions follow the links. Every top that a row's actions reach carries the least
(cost, audit) of the parses that end there; equal tops are merged by that pair. Two audits of equal
cost over the same rows are never prefixes of each other (the longer one has more insertions), so the
merge is exact: what follows can't change the order.

A conversation is dealt out in blocks of neighbouring turns. A block of a long one gives the least
pair from every top to every top; the pairs of its blocks are added up in turn order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import partitions
from loomgraph.session import cut_lineage

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
CUT_SHORT = 3
ROLES = {"u": "user", "a": "assistant"}
# fixed values: LR tables of the grammar above
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 5, (3, "u"): 6, (4, "u"): 6, (6, "a"): 7}
REDUCE = {5: 2, 7: 3}  # states that end a B: symbols to pop
GOTO = {0: 3, 1: 4}
ACCEPT = {0, 3, 4}
LEGAL = {"su", "ua", "au"}

_SPACE = " \t\n\x0b\x0c\r"
_TURNS, _CHARS = 8, 1 << 22  # a block: turns with the same bits above the 8th, and so many characters before it is parted
_FREE, _BLANK, _SEEN, _SHORT = range(4)
_INITIALS = "sua?"
Front = dict[int, tuple[int, str]]


class Stacks:
    """Nodes (state, link to the node beneath) of all stacks; node 0 is the empty stack."""

    def __init__(self):
        self.nodes: list[tuple[int, int]] = [(0, -1)]
        self.ids = {(0, -1): 0}
        self.after: dict[tuple[int, str], int | None] = {}

    def node(self, state: int, below: int) -> int:
        if (state, below) not in self.ids:
            self.ids[state, below] = len(self.nodes)
            self.nodes.append((state, below))
        return self.ids[state, below]

    def push(self, top: int, symbol: str) -> int | None:
        """The top after a shift of the symbol and the reductions that follow; None where no parse goes on."""
        if (top, symbol) not in self.after:
            state = SHIFT.get((self.nodes[top][0], symbol))
            to = None if state is None else self.node(state, top)
            while to is not None and self.nodes[to][0] in REDUCE:
                for _ in range(REDUCE[self.nodes[to][0]]):
                    to = self.nodes[to][1]
                to = self.node(GOTO[self.nodes[to][0]], to)
            self.after[top, symbol] = to
        return self.after[top, symbol]

    def tops(self) -> list[int]:
        """All tops that any input reaches (the grammar is regular: there are eight)."""
        seen = [0]
        for top in seen:
            seen += [t for t in (self.push(top, c) for c in "sua") if t is not None and t not in seen]
        return seen


STACKS = Stacks()
TOPS = STACKS.tops()


def _offer(front: Front, top: int | None, cost: int, audit: str) -> None:
    if top is not None and (top not in front or (cost, audit) < front[top]):
        front[top] = (cost, audit)


def _inserted(front: Front) -> Front:
    """The front and what insertions reach from it (two at most bring a top that none brought before)."""
    out = dict(front)
    for _ in range(2):
        for top, (cost, audit) in list(out.items()):
            for symbol in ROLES:
                _offer(out, STACKS.push(top, symbol), cost + INSERT, audit + "I")
    return out


def letter(role: str, fault: int) -> str:
    """One character for what repair needs to know of a row: its role's initial and its fault."""
    return chr(65 + 4 * (_INITIALS.index(role[0]) if role[:1] in ("s", "u", "a") else 3) + fault)


def _read(code: str) -> tuple[str, int]:
    k = ord(code) - 65
    return _INITIALS[k // 4], k % 4


def advance(front: Front, letters: str) -> Front:
    """The front after the rows, each with the insertions before it."""
    for code in letters:
        initial, fault = _read(code)
        more: Front = {}
        for top, (cost, audit) in _inserted(front).items():
            _offer(more, top, cost + DELETE, audit + "D")
            if fault not in (_BLANK, _SEEN):
                extra = CUT_SHORT * (fault == _SHORT)
                _offer(more, STACKS.push(top, initial), cost + KEEP + extra, audit + "K")
                for symbol in ROLES:
                    _offer(more, STACKS.push(top, symbol), cost + REROLE + extra, audit + "R")
        front = more
    return front


def _joined(front: Front, paths: list[Front]) -> Front:
    """The front after a block whose least pairs from every top are known."""
    out: Front = {}
    for top, (cost, audit) in front.items():
        for to, (further, rest) in paths[TOPS.index(top)].items():
            _offer(out, to, cost + further, audit + rest)
    return out


def finished(front: Front) -> tuple[int, str]:
    """The least (cost, audit) of the parses that the grammar accepts here."""
    return min(pair for top, pair in _inserted(front).items() if STACKS.nodes[top][0] in ACCEPT)


@lru_cache(1 << 16)
def _short(letters: str) -> tuple[int, str]:
    return finished(advance({0: (0, "")}, letters))


def _slices(audit: str, sizes: list[int]) -> list[str]:
    """The audit cut at the blocks' ends; insertions go with the row that they precede, the last ones with the last block."""
    out, at = [], 0
    for size in sizes:
        start = at
        while size:
            size -= audit[at] != "I"
            at += 1
        out.append(audit[start:at])
    out[-1] += audit[at:]
    return out


def _keys(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    return df.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"))


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, gone): rows with faults that crc32 of `conv_id:turn` modulo 20 chooses.

    0 drops a row (it stays as a row that is gone, so that its conversation is still known), 1 empties
    the text, 2 removes its stops, 3 repeats the row, 4 makes the role user. Nulls count as one space,
    also in the text that is hashed; a null conv_id or turn stays null in its column.
    """
    rows = _keys(df, conv, turn, role, text)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    changed = rows.withColumn("kind", kind).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    )
    return changed.drop("copy")


def rows_of(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The table as rows for repair, undamaged; nulls in role or text count as one space."""
    return _keys(df, conv, turn, role, text).withColumn("gone", F.lit(False))


_BLOCKS = "turn_block long, sub int, letters string, low long, high long, turns long, roles array<string>, texts array<string>"


def _blocks(rows: DataFrame) -> DataFrame:
    """(conv_id, turn_block, sub, letters, low, high, turns, roles, texts): neighbouring rows in order.

    A conversation's rows are ordered by turn (null first), then role and text. A row is seen when
    an earlier turn has its role and text, or the row before is the same.
    """
    live = rows.where(~F.col("gone"))
    mark = [F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2")]
    again = (
        live.select("conv_id", "role", "turn", *mark).groupBy("conv_id", "role", "h1", "h2")
        .agg(F.count("*").alias("n"), F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("null_first"))
        .where("n > 1").drop("n").withColumnRenamed("conv_id", "c").withColumnRenamed("role", "r")
    )
    hashed = rows.select("*", *mark).alias("x")
    joined = hashed.join(
        again.alias("y"),
        F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("x.h1") == F.col("y.h1")) & (F.col("x.h2") == F.col("y.h2")),
        "left",
    )
    later = F.when(F.col("null_first"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first"))
    dealt = (
        joined.select("conv_id", F.shiftright("turn", _TURNS).alias("turn_block"), "turn", "role", "text", "gone", F.coalesce(later, F.lit(False)).alias("later"))
        .repartition(partitions(rows), "conv_id", "turn_block")
        .sortWithinPartitions("conv_id", "turn_block", "turn", "role", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        key, sub, before, block, size = None, 0, None, None, 0

        def out():
            values = [[key[0]], [key[1]], [sub], ["".join(block["letters"])], [block["low"]], [block["high"]], [block["turns"]], [block["roles"]], [block["texts"]]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kind)], names)

        def fresh():
            return {"letters": [], "low": None, "high": None, "turns": 0, "roles": [], "texts": []}

        names = ["conv_id", "turn_block", "sub", "letters", "low", "high", "turns", "roles", "texts"]
        for batch in batches:
            listed = pa.list_(pa.string())
            kind = [batch["conv_id"].type, pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), listed, listed]
            columns = [batch[c].to_pylist() for c in ("conv_id", "turn_block", "turn", "role", "text", "gone", "later")]
            for conv, part, turn, role, text, gone, later in zip(*columns):
                if key != (conv, part):
                    if key is not None:
                        yield out()
                    key, sub, before, block, size = (conv, part), 0, None, fresh(), 0
                elif size > _CHARS:
                    yield out()
                    sub, block, size = sub + 1, fresh(), 0
                if gone:
                    continue
                if turn is not None and (before is None or before[0] != turn):
                    block["low"] = turn if block["low"] is None else block["low"]
                    block["high"] = turn
                    block["turns"] += 1
                last = text.rstrip(_SPACE)[-1:]
                fault = _BLANK if not last else _SEEN if later or before == (turn, role, text) else _FREE if last in ".!?" else _SHORT
                before = (turn, role, text)
                block["letters"].append(letter(role, fault))
                block["roles"].append(role)
                block["texts"].append(text)
                size += len(text) + 64
        if key is not None:
            yield out()

    return dealt.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {_BLOCKS}")


def _paths(letters: str) -> list[Front]:
    return [advance({top: (0, "")}, letters) for top in TOPS]


_STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _counts(blocks: list[tuple]) -> list[int]:
    """gaps, blank, duplicate, truncated, illegal of a conversation's blocks in order."""
    low, high = [b[3] for b in blocks if b[3] is not None], [b[4] for b in blocks if b[4] is not None]
    gaps = max(high) - min(low) + 1 - sum(b[5] for b in blocks) if low else 0
    blank = seen = short = illegal = 0
    last = ""
    for b in blocks:
        for initial, fault in map(_read, b[2]):
            blank, seen, short = blank + (fault == _BLANK), seen + (fault == _SEEN), short + (fault == _SHORT)
            illegal += bool(last) and last + initial not in LEGAL
            last = initial
    return [gaps, blank, seen, short, illegal]


def _plans(blocks: DataFrame) -> DataFrame:
    """Per block its part of the audit, and on the last block of a conversation what holds for all of it."""
    kind = blocks.schema["conv_id"].dataType.simpleString()
    slim = blocks.select("conv_id", "turn_block", "sub", "letters", "low", "high", "turns")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the least pairs from top to top for the blocks that lie past a conversation's usual first one."""
        for batch in batches:
            found = []
            for part, sub, letters in zip(batch["turn_block"].to_pylist(), batch["sub"].to_pylist(), batch["letters"].to_pylist()):
                paths = [] if sub == 0 and part in (None, 0) else _paths(letters)
                found.append([{"a": i, "b": b, "cost": c, "audit": a} for i, front in enumerate(paths) for b, (c, a) in front.items()])
            shape = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, shape)], [*batch.schema.names, "paths"])

    shaped = f"conv_id {kind}, turn_block long, sub int, letters string, low long, high long, turns long, paths array<struct<a:int,b:int,cost:long,audit:string>>"
    sorted_ = slim.mapInArrow(measured, shaped).repartition(partitions(blocks), "conv_id").sortWithinPartitions("conv_id", "turn_block", "sub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple] = []
        schema = None

        def close() -> None:
            if len(held) == 1:
                cost, audit = _short(held[0][2])
            else:
                front: Front = {0: (0, "")}
                for b in held:
                    front = _joined(front, b[6]) if b[6] else advance(front, b[2])
                cost, audit = finished(front)
            parts = _slices(audit, [len(b[2]) for b in held])
            stats = _counts(held)
            for i, (b, part) in enumerate(zip(held, parts)):
                final = i == len(held) - 1
                out.append((*b[0], b[1], part, final, *(stats if final else [None] * 5), cost if final else None, audit if final else None))

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), schema)], names)

        names = ["conv_id", "turn_block", "sub", "part", "final", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        for batch in batches:
            schema = [batch["conv_id"].type, pa.int64(), pa.int32(), pa.string(), pa.bool_(), *[pa.int64()] * 6, pa.string()]
            for conv, place, sub, letters, low, high, turns, paths in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0][0] != conv:
                    close()
                    held = []
                    if len(out) >= 2048:
                        yield packed()
                        out = []
                table: list[Front] = [{} for _ in TOPS] if paths else []
                for p in paths:
                    table[p["a"]][p["b"]] = (p["cost"], p["audit"])
                held.append(((conv, place), sub, letters, low, high, turns, table))
        if held:
            close()
        if out:
            yield packed()

    return sorted_.mapInArrow(run, f"conv_id {kind}, turn_block long, sub int, part string, final boolean, {_STATS}")


def _edited(blocks: DataFrame) -> tuple[DataFrame, str]:
    """Each block's part of the audit right before its rows, in order; the type of conv_id."""
    plans = _plans(blocks)
    nothing = lambda names, like: [F.lit(None).cast(like.schema[n].dataType).alias(n) for n in names]  # noqa: E731
    stats = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    both = plans.select("conv_id", "turn_block", "sub", F.lit(0).alias("rank"), "part", "final", *stats, *nothing(["roles", "texts"], blocks)).unionByName(
        blocks.select("conv_id", "turn_block", "sub", F.lit(1).alias("rank"), *nothing(["part", "final", *stats], plans), "roles", "texts")
    )
    dealt = both.repartition(partitions(blocks), "conv_id").sortWithinPartitions("conv_id", "turn_block", "sub", "rank")
    return dealt, blocks.schema["conv_id"].dataType.simpleString()


class _Writer:
    """Roles of a repaired conversation as its audit is read: user and assistant in turn, after a kept opening role."""

    def __init__(self):
        self.place, self.opened = 0, False

    def rows(self, part: str, roles: list[str], texts: list[str]) -> Iterator[tuple[int, str, str, str]]:
        row = 0
        for edit in part:
            if edit == "I":
                role, text = self._next(), ""
            else:
                role, text = roles[row], texts[row]
                row += 1
                if edit == "D":
                    continue
                if edit == "R":
                    role = self._next()
            if self.place == 0 and edit == "K" and role[:1] == "s":
                self.opened = True
            yield self.place, role, text, edit
            self.place += 1

    def _next(self) -> str:
        return ROLES["ua"[(self.place - self.opened) % 2]]


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the rows of every repaired conversation, numbered from 0; edit is K, R or I.

    ``rows`` are those of rows_of() or damaged(). Ties of turn go by role, then text. See report().
    """
    dealt, kind = _edited(cut_lineage(_blocks(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, writer, part, new = None, _Writer(), "", True
        for batch in batches:
            out: list[tuple] = []
            for c, rank, p, roles, texts in zip(*(batch[n].to_pylist() for n in ("conv_id", "rank", "part", "roles", "texts"))):
                if new or c != conv:
                    conv, writer, new = c, _Writer(), False
                if rank == 0:
                    part = p
                else:
                    out += [(c, *row) for row in writer.rows(part, roles, texts)]
            if out:
                types = [batch["conv_id"].type, pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], ["conv_id", "place", "role", "text", "edit"])

    return dealt.mapInArrow(run, f"conv_id {kind}, place long, role string, text string, edit string")


def report(rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``rows`` (also those whose rows are all gone): counts of faults, the cheapest repair, its digest.

    gaps (turns left out between the lowest and highest, nulls ignored), blank, duplicate, truncated,
    illegal (neighbours not su, ua or au), cost, audit (K, R, D, I in order; ASCII-least of the
    cheapest), repaired_sha256 of `role:text` lines. Null conv_ids are one conversation, null turns
    come first, equal rows are repeats, other rows of one turn go by role, then text. Empty texts are
    blank. A role that starts with none of s, u, a can't be kept. An empty table gives an empty
    result; other columns are not read. Texts are hashed block by block; a conversation needs memory
    for a few bytes per row only, and its blocks are parsed apart.
    """
    dealt, kind = _edited(cut_lineage(_blocks(rows)))
    stats = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, writer, part, new, digest, found, final = None, _Writer(), "", True, hashlib.sha256(), (), False
        for batch in batches:
            out: list[tuple] = []
            for c, rank, p, end, roles, texts, *values in zip(*(batch[n].to_pylist() for n in ("conv_id", "rank", "part", "final", "roles", "texts", *stats))):
                if new or c != conv:
                    conv, writer, new, digest = c, _Writer(), False, hashlib.sha256()
                if rank == 0:
                    part, final, found = p, end, values
                    continue
                for place, role, text, _ in writer.rows(part, roles, texts):
                    digest.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                if final:
                    out.append((c, *found, digest.hexdigest()))
            if out:
                types = [batch["conv_id"].type, *[pa.int64()] * 6, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], ["conv_id", *stats, "repaired_sha256"])

    return dealt.mapInArrow(run, f"conv_id {kind}, {_STATS}, repaired_sha256 string")


SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS byte),
src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations),
dealt AS (
  SELECT src.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(name) + 1), lambda i: ascii(name[i]))),
    lambda c, b: xor(c >> 8, byte[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM src, crc),
rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM dealt, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM rows),
judged AS MATERIALIZED (
  SELECT conv_id, turn, role, text, pos, role[1] AS initial,
    CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank'
         WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
         WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM placed),
move(a, initial, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
fill(a, b, audit, lines) AS (VALUES (0, 0, '', []), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']),
  (2, 3, 'I', ['assistant:']), (3, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:'])),
edit AS MATERIALIZED (
  SELECT conv_id, pos, s.a, s.a AS b, 4 AS cost, 'D' AS audit, []::VARCHAR[] AS lines FROM judged, (VALUES (0), (1), (2), (3)) s(a)
  UNION ALL
  SELECT conv_id, pos, a, b, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', [role || ':' || text] FROM judged JOIN move USING (initial) WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL
  SELECT conv_id, pos, a, b, CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R', [CASE move.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text]
  FROM judged, move WHERE move.initial <> 's' AND fault NOT IN ('blank', 'duplicate')),
best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0 AS state, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS way FROM src
  UNION ALL
  SELECT e.conv_id, e.pos, e.b, min({'cost': way.cost + 3 * length(f.audit) + e.cost, 'audit': way.audit || f.audit || e.audit, 'lines': way.lines || f.lines || e.lines})
  FROM best JOIN fill f ON f.a = state JOIN edit e ON e.conv_id IS NOT DISTINCT FROM best.conv_id AND e.pos = best.pos + 1 AND e.a = f.b
  GROUP BY e.conv_id, e.pos, e.b),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pos > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
done AS (
  SELECT conv_id, min({'cost': way.cost + 3 * length(f.audit), 'audit': way.audit || f.audit, 'lines': way.lines || f.lines}) AS way
  FROM best LEFT JOIN counts USING (conv_id) JOIN fill f ON f.a = state AND f.b IN (0, 3)
  WHERE best.pos = coalesce(n, 0) GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, way.cost::BIGINT AS cost, way.audit AS audit, sha256(array_to_string(way.lines, chr(10))) AS repaired_sha256
FROM done LEFT JOIN counts USING (conv_id)"""
