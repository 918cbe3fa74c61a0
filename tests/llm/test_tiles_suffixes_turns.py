"""Operators 11 to 13 against brute force on small, awkward tables: ties, repeats, nulls, borders everywhere."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from quern.llm import conversation_repair, suffix_dedup
from quern.llm.conversation_repair import damaged, repair_conversations
from quern.llm.sequence_patterns import SECOND, click_events, sequence_patterns
from quern.llm.suffix_dedup import remove_seen_bytes

# ---- 11 ----


def supporters(events, longest, gap, span):
    """pattern -> clients, by walking every occurrence."""
    mine, out = defaultdict(set), defaultdict(set)
    for c, t, k in events:
        mine[c].add((t, k))
    for c, own in mine.items():
        own = sorted(own)
        now = {((k,), t, t) for t, k in own}
        for _ in range(longest):
            for p, _, _ in now:
                out[p].add(c)
            now = {((*p, k), b, t2) for p, b, t in now for t2, k in own if 0 < t2 - t <= gap and t2 - b <= span}
    return out, len(mine)


def closed_patterns(events, longest, gap, span, least, percent):
    found, people = supporters(events, longest, gap, span)
    kept = {p: c for p, c in found.items() if len(c) >= least and 100 * len(c) >= percent * people}
    parts = {p: {q for n in range(1, len(p)) for q in itertools.combinations(p, n)} for p in kept}
    out = set()
    for p, c in kept.items():
        wider = sum(p in parts[q] and len(d) == len(c) for q, d in kept.items())
        out.add((">".join(p), len(p), len(c), sum(zlib.crc32(str(x).encode()) for x in c), wider, not wider))
    return out


@pytest.mark.parametrize("tile", [3, 40, 100_000])
def test_patterns(spark, tile):
    r = random.Random(tile)
    events = [(r.choice([7, 7, 7, 8, 9, -1, 12]), r.randrange(0, 900, 10), r.choice("abc")) for _ in range(150)]
    events += [(7, 10**15, "a"), (7, -(10**15), "b"), (99, 5, "z"), *events[:20]]
    rows = [*events, (None, 1, "a"), (1, None, "a"), (1, 1, None)]
    frame = spark.createDataFrame(rows, "client long, t long, type string").repartition(3)
    got = sequence_patterns(frame.selectExpr("*", "1 as support", "'x' as types"), 4, 60, 90, 2, 3, tile)
    assert {tuple(x) for x in got.collect()} == closed_patterns(events, 4, 60, 90, 2, 3)
    assert sequence_patterns(frame.where("false")).count() == 0


def test_click_events(spark):
    at = datetime(2024, 3, 31, 2, 30, 0, 123456)
    rows = [(i, at + timedelta(days=i), 5, "view") for i in range(40)] + [(None, at, 5, "view"), (1, None, 5, "view"), (1, at, None, "view"), (1, at, 5, None)]
    want = []
    for i, t, _, _ in rows[:41]:
        us = (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
        marked = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        want += [(5, us, "view")] + marked * [(5, us - SECOND, "open"), (5, us + SECOND, "shut")]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        got = click_events(spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, client_id long, kind string"))
        assert sorted(map(tuple, got.collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


# ---- 12 ----


def removed(rows, window):
    """One (id, bytes, removed, spans, kept) a row."""
    least = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    order = lambda i: (i is None, i or 0)
    for i, b in texts:
        for k in range(len(b) - window + 1):
            w = b[k : k + window]
            least[w] = min(least.get(w, order(i)), order(i))
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for k in range(len(b) - window + 1):
            if order(i) > least[b[k : k + window]]:
                gone[k : k + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("sizes", [None, (600, 500, 1)])
def test_suffixes(spark, monkeypatch, sizes):
    if sizes:
        for name, value in zip(("UNIT_BYTES", "BUCKET_BYTES", "HOT_UNITS"), sizes, strict=True):
            monkeypatch.setattr(suffix_dedup, name, value)
    r = random.Random(1)
    words = ["".join(r.choices("abcdé", k=r.randrange(1, 9))) for _ in range(60)]
    text = lambda n: " ".join(r.choices(words, k=n))
    shared, other = text(40), text(15)
    texts = [None, "", "x", "x" * 49, "x" * 50, "x" * 400, "ab" * 90, "ab" * 100, shared, shared, shared[3:] + text(9), text(30) + shared, text(5) + other + text(7) + other, other, "日本語" * 30, "日本語" * 40]
    texts += [text(20) + shared[i : i + 49 + i] + text(20) for i in range(0, 60, 7)]
    rows = list(zip(r.sample(range(100), len(texts)), texts, strict=True)) + [(None, shared), (5000, text(9) + shared), (5000, shared + text(9)), (None, text(30))]
    frame = spark.createDataFrame([(i, t, b"") for i, t in rows], "doc_id long, text string, blob binary").repartition(3)
    got = sorted(remove_seen_bytes(frame).collect(), key=repr)
    assert sorted(map(tuple, got), key=repr) == sorted(((*x[:4], bytearray(x[4])) for x in removed(rows, 50)), key=repr)
    assert remove_seen_bytes(frame.where("false")).count() == 0


def test_long_text(spark):
    r = random.Random(2)
    long = "".join(r.choices("abcdefgh ", k=700_000))
    rows = [(1, long[300_000:300_200]), (2, long), (3, "q" * 300_000), (4, "q" * 60)]
    got = {x.doc_id: x for x in remove_seen_bytes(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect()}
    assert [(got[i].n_removed, got[i].n_spans) for i in (1, 2, 3, 4)] == [(0, 0), (200, 1), (0, 0), (60, 1)]
    assert got[2].kept == hashlib.sha256((long[:300_000] + long[300_200:]).encode()).hexdigest()


# ---- 13 ----

def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        kind = "" if text.rstrip(" \t\n\x0b\x0c\r")[-1:] in (".", "!", "?") else "t"
        kind = "b" if not text.strip(" \t\n\x0b\x0c\r") else "d" if (role, text) in seen else kind
        seen.add((role, text))
        out.append(kind)
    return out


def repaired(rows):
    """(cost, audit, text) by trying every way, best first by row and state."""
    best = {"": (0, "", ())}

    def insert(ways):
        for _ in range(3):
            for tail, (c, a, t) in list(ways.items()):
                for name in ("user", "assistant"):
                    k, new = name[0], (c + 5, a + "I", (*t, f"{name}:"))
                    if (tail + k)[-2:] in ("u", "su", "ua", "au") and new[:2] < ways.get(k, (99**9,))[:2]:
                        ways[k] = new
        return ways

    for (_, role, text), kind in zip(rows, faults(rows), strict=True):
        after = {}
        for tail, (c, a, t) in insert(best).items():
            ways = [(tail, 2, "D", ())]
            if kind not in ("b", "d"):
                ways += [(k[0], 1 + 5 * (kind == "t"), "R", (f"{k}:{text}",)) for k in ("user", "assistant")] + [(role[:1], 5 * (kind == "t"), "K", (f"{role}:{text}",))]
            for k, cost, e, add in ways:
                if e == "D" or k and (tail + k)[-2:] in ("s", "u", "su", "ua", "au"):
                    new = (c + cost, a + e, t + add)
                    if new[:2] < after.get(k, (99**9,))[:2]:
                        after[k] = new
        best = after
    ends = insert(best)
    return min(ends[k] for k in ("", "a") if k in ends)


def expected(rows):
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    turns, kinds = [x[0] for x in rows if x[0] is not None], faults(rows)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    cost, audit, text = repaired(rows)
    return (gaps, *(kinds.count(k) for k in "bdt"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())


@pytest.mark.parametrize("piece", [1, 3, 256])
def test_repair(spark, piece):
    r = random.Random(5)
    texts = ["One.", "Two!", "cut off", "", " \n", "same?", "é", "end. \t", "None"]
    rows = []
    for conv in [*range(25), None]:
        for i in range(r.choice([1, 2, 3, 5, 9, 40])):
            rows.append((conv, r.choice([i, i, i + 1, None]), r.choice(["user", "assistant", "system", "tool", "user", "assistant", "", None]), r.choice([*texts, f"Turn {i}.", f"Turn {i}.", None])))
    rows += rows[:15]
    mine = defaultdict(list)
    for conv, turn, role, text in rows:
        mine[conv].append((turn, " " if role is None else role, " " if text is None else text))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {x.conv_id: tuple(x)[1:] for x in repair_conversations(frame.selectExpr("*", "1 as n", "'k' as ck"), piece).collect()}
    assert got == {c: expected(x) for c, x in mine.items()}
    assert repair_conversations(frame.where("false")).count() == 0


def test_damage(spark):
    rows = [(c, t, "user", "Some. Text!") for c in [*range(12), None] for t in (0, 1, None)]
    got = damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for x in got:
        code = zlib.crc32(f"{' ' if x.conv_id is None else x.conv_id}:{' ' if x.turn is None else x.turn}".encode()) % 20
        assert (x.text, x.copies) == ({1: "", 2: "Some Text"}.get(code, "Some. Text!"), {0: 0, 3: 2}.get(code, 1))
    dropped = spark.createDataFrame([(1, 1, "user", "a", 0)], "conv_id long, turn long, role string, text string, copies int")
    assert [tuple(x) for x in repair_conversations(dropped).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversation_repair.search([]) == {0: (0, "")}
