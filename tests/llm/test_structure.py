"""Conversation repair, vector codes and repeated substrings against plain versions."""

import hashlib
import itertools
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from loomgraph.llm import codes, conversation, suffixes

from .helpers import LONG, ODD, empty, odd

# --- conversations


def plain_repair(rows):
    """Least (cost, audit) by a search over grammar states, and the repaired lines."""
    move = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {0: (0, "", ())}

    def fill(front):
        for _ in range(2):
            for state, (cost, audit, lines) in list(front.items()):
                for c, name in (("u", "user"), ("a", "assistant")):
                    if (state, c) in move:
                        new = (cost + 3, audit + "I", (*lines, name + ":"))
                        to = move[state, c]
                        front[to] = min(front.get(to, new), new)
        return front

    for role, text, fault in rows:
        new = {}
        for state, (cost, audit, lines) in fill(best).items():
            options = [(state, cost + 4, audit + "D", lines)]
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                options += [(move[state, c], cost + 3 + extra, audit + "R", (*lines, f"{name}:{text}")) for c, name in (("u", "user"), ("a", "assistant")) if (state, c) in move]
                if (state, role[:1]) in move:
                    options.append((move[state, role[:1]], cost + extra, audit + "K", (*lines, f"{role}:{text}")))
            for to, *way in options:
                new[to] = min(new.get(to, tuple(way)), tuple(way))
        best = new
    return min(way for state, way in fill(best).items() if state in (0, 3))


def plain_report(table):
    rows = []
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv in {r[0] for r in table}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, judged = set(), []
        for _, _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            judged.append((role, text, fault))
        cost, audit, lines = plain_repair(judged)
        turns = {r[1] for r in mine} - {None}
        n = Counter(f for _, _, f in judged)
        initials = [r[:1] for r, _, _ in judged]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def talk(seed):
    rnd = random.Random(seed)
    rows = [(None, None, None, None), (None, 1, "user", "a?"), (-5, None, "user", "x."), (-5, None, "user", "x."), (-5, 3, "user", "x."), (-6, 0, "user", None)]
    for conv in range(120):
        for turn in range(rnd.randint(1, 12)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "u", "", None])
            rows.append((conv, rnd.choice([turn, turn, turn, turn * 200 - 300, None]), role, rnd.choice(["yes.", "no", " ", "", "what?", "ok!  \n", None, f"line {turn}."])))
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", f"text {t % 700}.") for t in range(-600, 1500)]
    rows += [(501, 7, "user", f"same turn {k}") for k in range(300)] + [(502, t, "user", LONG) for t in range(4)]
    return rows


def reported(df):
    got = conversation.report(df).collect()
    return {r["conv_id"]: tuple(r)[1:] for r in got}


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_plain_search(spark, seed):
    table = talk(seed)
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").selectExpr("*", "1 letters", "2 part", "'x' audit")
    assert reported(conversation.damaged(df)) == plain_report(table)


def test_blocks_part_by_size(spark, monkeypatch):
    monkeypatch.setattr(conversation, "_CHARS", 200)
    table = talk(3)
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    assert reported(conversation.damaged(df)) == plain_report(table)


def test_equal_tops_are_merged():
    assert len(conversation.TOPS) == 8
    for letters in map("".join, itertools.product(*[[conversation.letter(r, f) for r in ("s", "u", "a", "x") for f in (0, 1, 3)]] * 3)):
        rows = [("suax"[(ord(c) - 65) // 4], "t.", ["", "blank", "duplicate", "truncated"][(ord(c) - 65) % 4]) for c in letters]
        whole = conversation.finished(conversation.advance({0: (0, "")}, letters))
        assert whole == plain_repair(rows)[:2]
        front = conversation._joined(conversation.advance({0: (0, "")}, letters[:1]), conversation._paths(letters[1:]))
        assert conversation.finished(front) == whole


def test_repaired_rows(spark):
    table = [(1, 0, "system", "s."), (1, 1, "user", "q?"), (1, 2, "user", "q?"), (1, 3, "assistant", "a."), (1, 4, "assistant", "b."), (2, 0, "user", "  ")]
    df = conversation.rows_of(spark.createDataFrame(table, "conv_id long, turn long, role string, text string"))
    rows = sorted(tuple(r) for r in conversation.repaired(df).collect())
    audit = {r["conv_id"]: r["audit"] for r in conversation.report(df).collect()}
    # deleting the second answer costs 4, a turn put in before it 3
    assert audit == {1: "KKDKIK", 2: "D"}
    assert rows == [(1, 0, "system", "s.", "K"), (1, 1, "user", "q?", "K"), (1, 2, "assistant", "a.", "K"), (1, 3, "user", "", "I"), (1, 4, "assistant", "b.", "K")]


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation.report(conversation.damaged(none)).collect() == [] == conversation.repaired(conversation.rows_of(none)).collect()


# --- vector codes


def plain_codes(table, parts=4, entries=256, rounds=4):
    kept = [(i, v, x) for i, v, x in table if v and all(c is not None and np.isfinite(c) for c in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = -(-len(kept[0][1]) // parts)
    whole = [[min(max(int(np.floor(c * 1024)), -(1 << 26)), 1 << 26) for c in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    cut = [[w[p * width : (p + 1) * width] for p in range(parts)] for w in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for c in cut:
                mine.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(col) // len(mine[k]) for col in zip(*mine[k])] if k in mine else e for k, e in enumerate(books[p])]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    per = Counter()
    for (_, _, x), e in zip(kept, errors):
        per[x] += e
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, per[x], sha) for (i, _, x), f, e in zip(kept, found, errors)), key=str)


def coded(spark, table, **options):
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 code", "2 error", "3 of_label", "'v' vector")
    return sorted((tuple(r) for r in codes.compressed(df, **options).collect()), key=str)


def test_codes_equal_plain_search(spark):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(30, 6)).astype(np.float32)
    table = [(i, base[rnd.integers(30)].tolist() if i % 3 else (rnd.normal(size=6) * 2).astype(np.float32).tolist(), None if i % 7 == 0 else i % 5) for i in range(150)]
    table += [(None, base[0].tolist(), 1), (5, base[1].tolist(), 2), (5, base[2].tolist(), 2), (900, None, 1), (901, [1.0, None] * 3, 1), (902, [float("nan")] * 6, 0)]
    table += [(903, [float("inf")] * 6, 0), (904, [], 0), (905, [1.0], 0), (906, [1e30, -1e30, 0.0, 0.0, 0.0, 0.0], 3)]
    assert coded(spark, table, entries=16) == plain_codes(table, entries=16)
    assert coded(spark, table[:10]) == plain_codes(table[:10])
    assert coded(spark, []) == []


def test_boxes_hold_the_nearest():
    rnd = np.random.default_rng(4)
    entries = rnd.integers(-40, 40, (200, 5))
    slices = codes.Slices(entries)
    x = np.r_[rnd.integers(-60, 60, (500, 5)), entries[:20], rnd.integers(-(1 << 26), 1 << 26, (5, 5))]
    best, error = slices.nearest(x)
    away = ((x[:, None] - entries) ** 2).sum(axis=2)
    assert (best == away.argmin(axis=1)).all() and (error == away.min(axis=1)).all()
    near = slices.nearest(x[:-5])  # the other way to measure
    assert (near[0] == best[:-5]).all() and (near[1] == error[:-5]).all()
    assert (slices.box(x, np.full(len(x), 9)) == (abs(x[:, None] - entries) <= 9).all(axis=2)).all()


# --- repeated substrings


def plain_cleaned(texts, size=200):
    bodies = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + size] for b in bodies for i in range(len(b) - size + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, kept, hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 8))) for _ in range(500)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    shared = [prose(60) for _ in range(8)]
    texts = [None, "", "x" * 199, "x" * 200, "x" * 201, "y" * 1000, "ab" * 400, prose(3000), "\0" * 300, "\U0010ffff" * 120]
    for _ in range(150):
        t = prose(rnd.randint(5, 80))
        for _ in range(rnd.randint(0, 3)):
            p, a = rnd.choice(shared), rnd.randint(0, 100)
            t += p[a : a + rnd.randint(150, 330)] + prose(rnd.randint(1, 30))
        texts.append(t)
    return texts + [texts[20]] * 3 + [texts[30][:-1] + "z", texts[30], texts[7][500:9000]]


@pytest.mark.parametrize("options", [{}, {"block": 5000, "slot": 20_000}, {"block": 5000, "slot": 20_000, "limit": 3}, {"limit": 1}])
def test_substrings_equal_plain_count(spark, options):
    texts = passages(5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]), r["kept_sha256"]) for r in suffixes.cleaned(df, **options).collect()}
    assert got == dict(enumerate(plain_cleaned(texts)))


def test_odd_rows(spark):
    got = suffixes.cleaned(odd(spark)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    want = [(i, *w) for (i, _), w in zip(ODD, plain_cleaned([t for _, t in ODD]))]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert suffixes.cleaned(empty(spark)).collect() == []


def test_transform_orders_suffixes():
    rnd = random.Random(2)
    for _ in range(60):
        strings = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 40))).encode() for _ in range(rnd.randint(1, 12))]
        group = sorted(rnd.randint(0, 3) for _ in strings)
        rows = suffixes.transform(np.frombuffer(b"".join(strings), np.uint8), np.array(list(map(len, strings))), np.array(group))
        want = sorted((g, bytes(x + 1 for x in s[i:]) + b"\0", k, i) for k, (g, s) in enumerate(zip(group, strings)) for i in range(len(s) + 1))
        assert rows.tolist() == [strings[k][i - 1] + 1 if i else 0 for _, _, k, i in want]
