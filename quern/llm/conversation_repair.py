"""Cheapest repair of conversations: A* on the lattice of rows and role states, long conversations in pieces."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._common import by_group, prepare, work_table

KEEP, REROLE, DELETE, TRUNCATED, INSERT = 0, 1, 2, 5, 5
#: Rows and characters of a piece at most, one row at least.
PIECE_ROWS, PIECE_CHARS = 256, 4_000_000

# What has been said so far: nothing, a system turn, a user turn, an assistant turn. A repaired conversation ends in 0 or 3.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_SAY = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
#: Insertions that end a conversation from each state.
_TAIL = {0: "", 1: "II", 2: "I", 3: ""}

_RESULT = "ck string, piece long, cost long, audit string, illegal long, sha string, first string, last string, moves string, roles array<string>, texts array<string>, forced array<long>, truncated array<boolean>"
_SCHEMA = pa.schema([(c, pa.string()) for c in ("ck",)] + [("piece", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64()), ("sha", pa.string()), ("first", pa.string()), ("last", pa.string()), ("moves", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("forced", pa.list_(pa.int64())), ("truncated", pa.list_(pa.bool_()))])


def search(rows: list[tuple[int, str, bool]], begin: int = 0, whole: bool = True) -> dict[int, tuple[int, str]]:
    """state after the rows -> (cost, audit) of the cheapest edits that lead there from state `begin`, ties ASCII-least.

    `rows` has (n, initial, truncated): n > 0 rows that must go, or one row that may stay. A* on nodes (rows done, state),
    keyed by cost plus heuristic, then audit. The heuristic sums over the rows to come what cannot be avoided: 2 for each that
    must go, and 2 for a truncated one, as deletion is cheaper than its charge; it never falls by more than an edit costs, so
    the first time a node is taken is the best. With `whole` only the best end of a conversation is returned, insertions at its end
    included; without, all states, and insertions stand before rows only, so that no audit is the beginning of another.
    """
    m = len(rows)
    ahead = [0] * (m + 1)
    for i in range(m - 1, -1, -1):
        n, _, truncated = rows[i]
        ahead[i] = ahead[i + 1] + (DELETE * n if n else min(DELETE, TRUNCATED) * truncated)
    heap, done, ends = [(ahead[0], "", 0, begin)], set(), {}
    while heap:
        f, audit, i, q = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        cost = f - ahead[i]
        if i == m:
            if not whole:
                ends[q] = (cost, audit)
                continue
            if q in (0, 3):
                return {q: (cost, audit)}
        if i < m:
            n, r, truncated = rows[i]
            if n:
                heapq.heappush(heap, (cost + DELETE * n + ahead[i + 1], audit + "D" * n, i + 1, q))
            else:
                charge = TRUNCATED * truncated + ahead[i + 1] + cost
                heapq.heappush(heap, (cost + DELETE + ahead[i + 1], audit + "D", i + 1, q))
                heapq.heappush(heap, (charge + REROLE, audit + "R", i + 1, _SAY[q][1]))
                if (q, r) in _NEXT:
                    heapq.heappush(heap, (charge + KEEP, audit + "K", i + 1, _NEXT[q, r]))
        heapq.heappush(heap, (f + INSERT, audit + "I", i, _SAY[q][1]))
    return ends


def said(rows: Iterable[tuple[int, str, str]], state: int, audit: str) -> Iterator[str]:
    """`role:text` of each turn that the edits leave, of rows (n that must go, role, text)."""
    at = 0
    for n, role, text in [*rows, (0, "", "")]:
        while audit[at : at + 1] == "I":
            name, state = _SAY[state]
            yield f"{name}:"
            at += 1
        edit = audit[at : at + 1]
        if n or not edit:
            at += n
            continue
        at += 1
        if edit == "R":
            role, state = _SAY[state]
        elif edit == "K":
            state = _NEXT[state, role[:1]]
        if edit != "D":
            yield f"{role}:{text}"


def illegal(initials: list[tuple[str, int]]) -> int:
    """Adjacent initials other than su, ua and au, of (initial, how many times in a row)."""
    inside = sum(n - 1 for _, n in initials)
    return inside + sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of sorted rows, a result for each conversation that begins and ends inside this partition and is short, pieces of the others."""
    part, made = TaskContext.get().partitionId(), 0
    out: list[dict] = []

    def piece(ck, rows, cut):
        nonlocal made
        forced, roles, texts, truncated, counts = ([r[k] for r in rows] for k in range(5))
        lattice = [(f, r[:1], t) for f, r, t in zip(forced, roles, truncated, strict=True)]
        one = dict.fromkeys(_SCHEMA.names) | {"ck": ck, "illegal": illegal([(r[:1], n) for r, n in zip(roles, counts, strict=True) if n])}
        if not cut:
            ((cost, audit),) = search(lattice).values()
            text = "\n".join(said(zip(forced, roles, texts, strict=True), 0, audit))
            return one | {"cost": cost, "audit": audit, "sha": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()}
        moves = ";".join(f"{p}{q}{cost}:{audit}" for p in range(4) for q, (cost, audit) in search(lattice, p, False).items())
        made += 1
        return one | {"piece": (part << 32) + made, "moves": moves, "first": roles[0][:1], "last": roles[-1][:1], "roles": roles, "texts": texts, "forced": forced, "truncated": truncated}

    def flush(least=1):
        if len(out) >= least:
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)
            out.clear()

    now, rows, chars, cut = None, [], 0, True  # the first conversation may have begun in the partition before
    for batch in batches:
        for r in batch.to_pylist():
            if r["ck"] != now or len(rows) >= most or chars >= PIECE_CHARS:
                same = r["ck"] == now
                if rows:
                    out.append(piece(now, rows, cut or same))
                    yield from flush(200)
                cut = same or now is None
                now, rows, chars = r["ck"], [], 0
            must = r["n"] - r["free"]
            if r["free"]:
                # a row that may stay, with what its copies after it add to the initials in a row
                rows.append((0, r["role"], r["text"], r["truncated"], r["n"]))
            if must:
                rows.append((must, r["role"], "", False, 0 if r["free"] else must))
            chars += len(r["text"])
    if rows:
        out.append(piece(now, rows, True))  # the last may go on in the next partition
    yield from flush()


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each piece and the edits in it, of pieces in order of conversation; held are four back pointers a piece."""
    schema = pa.schema([("ck", pa.string()), ("piece", pa.int64()), ("state", pa.int32()), ("edits", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())])

    def finish(ck, steps, best, wrong):
        # best: state -> (cost, order of its audit)
        cost, _, q = min((c + INSERT * len(_TAIL[q]), order, q) for q, (c, order) in best.items())
        tail, rows = _TAIL[q], []
        for k in range(len(steps) - 1, -1, -1):
            piece, back = steps[k]
            p, audit = back[q]
            rows.append({"ck": ck, "piece": piece, "state": p, "edits": audit + (tail if k == len(steps) - 1 else ""), "cost": cost if not k else 0, "illegal": wrong if not k else 0})
            q = p
        return pa.RecordBatch.from_pylist(rows[::-1], schema)

    now, steps, best, wrong, last = None, [], {}, 0, ""
    for batch in batches:
        for r in batch.to_pylist():
            if r["ck"] != now:
                if steps:
                    yield finish(now, steps, best, wrong)
                now, steps, best, wrong, last = r["ck"], [], {0: (0, 0)}, 0, None
            wrong += r["illegal"] + (last is not None and last + r["first"] not in ("su", "ua", "au"))
            last, found = r["last"], {}
            for move in r["moves"].split(";"):
                head, audit = move.split(":")
                p, q, cost = int(head[0]), int(head[1]), int(head[2:])
                if p in best:
                    found.setdefault(q, []).append((best[p][0] + cost, best[p][1], audit, p))
            got = {q: min(ways) for q, ways in found.items()}
            order = {way: k for k, way in enumerate(sorted({w[1:3] for w in got.values()}))}
            best = {q: (w[0], order[w[1:3]]) for q, w in got.items()}
            steps.append((r["piece"], {q: (w[3], w[2]) for q, w in got.items()}))
    if steps:
        yield finish(now, steps, best, wrong)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each piece says once it is repaired."""
    for batch in batches:
        texts = ["\n".join(said(zip(r["forced"], r["roles"], r["texts"], strict=True), r["state"], r["edits"])) for r in batch.to_pylist()]
        says = pa.array([bool(x) for x in texts])
        yield pa.RecordBatch.from_arrays([batch.column("ck"), batch.column("piece"), batch.column("edits"), batch.column("cost"), batch.column("illegal"), pa.array(texts, pa.string()), says], names=["ck", "piece", "edits", "cost", "illegal", "text", "says"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One result of each conversation's pieces in order; the digest runs through them, one piece held at a time."""
    schema = pa.schema([("ck", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64()), ("sha", pa.string())])
    end = lambda: pa.RecordBatch.from_pylist([{"ck": now, "cost": cost, "audit": "".join(edits), "illegal": wrong, "sha": digest.hexdigest()}], schema)
    now, cost, wrong, edits, digest, begun = None, 0, 0, [], hashlib.sha256(), False
    for batch in batches:
        for r in batch.to_pylist():
            if r["ck"] != now:
                if now is not None:
                    yield end()
                now, cost, wrong, edits, digest, begun = r["ck"], 0, 0, [], hashlib.sha256(), False
            cost, wrong = cost + r["cost"], wrong + r["illegal"]
            edits.append(r["edits"])
            if r["says"]:
                digest.update((("\n" if begun else "") + r["text"]).encode("utf-8", "surrogatepass"))
                begun = True
    if now is not None:
        yield end()


def damaged(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, turn, role, text) with a fault in a quarter of them by crc32, and `copies`: 0 for a dropped row, 2 for a repeated one."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    code = F.crc32(key) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    got = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return got.select("conv_id", "turn", F.when(code == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"))


def repair_conversations(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    `rows` has conv_id, turn, role, text and, if a row counts several times or not at all, copies. A conversation's rows stand in
    order of turn (nulls first), then role and text. Each is at fault as blank (no character but white space), else duplicate
    (role and text came before), else truncated (ends in none of . ! ?). Edits: keep 0, re-role to user or assistant 1,
    delete 2 (a must for blank and duplicate rows), insert an empty turn 5; a truncated row that is not deleted adds 5. The edits
    make the roles' initials match (s?(ua)+)?, at the least cost, the ASCII-least audit of equal ones.

    Equal rows become one with a count, and repeats are found by sums, so no window gathers a conversation. Spark ranges
    the rows by conversation and turn; a conversation that lies within one task and is short is searched there. One that
    is long or cut by a border is searched in pieces, from each state to each state; the pieces are chained by back pointers, and
    its text passes through its digest piece by piece, never whole.

    A null conv_id is a conversation of its own; null roles and texts count as one space. Rows with copies 0 leave their conversation's
    row; one without any other has zeros, an empty audit and the digest of nothing. Other columns are not read; an empty table gives an empty one.
    """
    spark = prepare(rows.sparkSession)
    blank_text = F.lit(" ")
    ck = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    base = rows.select(ck.alias("ck"), "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank_text).alias("role"), F.coalesce("text", blank_text).alias("text"), copies.cast("long").alias("copies"))
    equal = work_table(spark, base.groupBy("ck", "conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n")), "turns")

    some = equal.where("n > 0")
    h = F.sha2(F.col("text"), 256)
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = some.groupBy("ck", "role", h.alias("h")).agg(F.min(place).alias("first_at"), F.count(F.lit(1)).alias("times")).where("times > 1")
    met = by_group(some.withColumn("h", h), again, ["ck", "role", "h"], "times", some.count(), "left")
    blank = ~F.col("text").rlike(r"[^ \t-\r]")
    later = F.coalesce(F.col("first_at") != place, F.lit(False))
    free = F.when(blank | later, 0).otherwise(1)
    cut_off = (free == 1) & ~F.col("text").rlike(r"[.!?][ \t-\r]*\z")
    judged = work_table(spark, met.select("ck", "turn", "role", "text", "n", free.cast("long").alias("free"), cut_off.alias("truncated"), blank.alias("blank")), "judged")
    sums = ("sum(if(blank, n, 0)) as blank", "sum(if(blank, 0, n - free)) as duplicate", "sum(if(truncated, 1, 0)) as truncated")
    by_turn = judged.groupBy("ck", "turn").agg(*map(F.expr, sums))
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    counts = by_turn.groupBy("ck").agg(F.coalesce(gaps, F.lit(0)).alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))

    place = F.col("turn").asc_nulls_first()
    order = judged.drop("blank").withColumn("near", F.substring("text", 1, 64)).repartitionByRange("ck", place, "role", "near").drop("near")
    pieces = work_table(spark, order.sortWithinPartitions("ck", place, "role", "text").mapInArrow(lambda it: _pieces(it, piece_rows), _RESULT), "pieces")
    narrow = pieces.where("piece is not null").select("ck", "piece", "illegal", "first", "last", "moves")
    plan = narrow.repartition("ck").sortWithinPartitions("ck", "piece").mapInArrow(_chain, "ck string, piece long, state int, edits string, cost long, illegal long")
    long = pieces.where("piece is not null").select("piece", "roles", "texts", "forced")
    told = plan.join(long.hint("merge"), "piece").select("ck", "piece", "state", "edits", "cost", "illegal", "roles", "texts", "forced").mapInArrow(_render, "ck string, piece long, edits string, cost long, illegal long, text string, says boolean")
    joined = told.repartition("ck").sortWithinPartitions("ck", "piece").mapInArrow(_digest, "ck string, cost long, audit string, illegal long, sha string")
    found = pieces.where("piece is null").select("ck", "cost", "audit", "illegal", "sha").unionByName(joined)

    ids = equal.groupBy("ck").agg(F.first("conv_id").alias("conv_id"))
    out = ids.join(counts.hint("merge"), "ck", "left").join(found.hint("merge"), "ck", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
