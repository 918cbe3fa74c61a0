"""Sequential patterns of timed events, mined in overlapping tiles of the timelines."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._common import drop_table, prepare, work_table

#: Events of a tile at most; a tile is what a task holds at once, beside its halo.
TILE_EVENTS = 200_000
SECOND = 1_000_000

_RUNS = "range long, begin long, n long, clients binary, times binary, types binary, names array<string>"
_TILES = "tile long, client_from long, t_from long, client_to long, t_to long, clients binary, times binary, types binary, names array<string>, near_t array<long>, near_type array<string>"
_FOUND = "types array<string>, client long, support long, crc long"


def micros(ts: Column, kind: str) -> Column:
    """Microseconds since 1970 of a time, without a zone for timestamp_ntz."""
    if kind != "timestamp_ntz":
        return F.unix_micros(ts)
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    clock = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long")
    return (day * 86_400 + clock) * SECOND + (F.date_part(F.lit("SECOND"), ts) * SECOND).cast("long")


def click_events(clicks: DataFrame) -> DataFrame:
    """(client, t, type): each click that has a client, a time and a kind; every fifth by crc32 of its id is opened a second before and shut a second after."""
    got = clicks.select("client_id", "click_id", F.col("kind").alias("type"), micros(F.col("ts"), dict(clicks.dtypes)["ts"]).alias("t")).where("client_id is not null and t is not null and type is not null")
    one = lambda name, shift: F.struct((F.col("t") + shift).alias("t"), name.alias("type"))
    own = one(F.col("type"), 0)
    three = F.array(one(F.lit("open"), -SECOND), own, one(F.lit("shut"), SECOND))
    marked = F.coalesce(F.crc32(F.col("click_id").cast("string")) % 5 == 0, F.lit(False))
    return got.select(F.col("client_id").cast("long").alias("client"), F.explode(F.when(marked, three).otherwise(F.array(own))).alias("e")).select("client", "e.t", "e.type")


def cut_runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """A row for each run of up to `most` events in order, with how many of its range lie before it."""
    schema = pa.schema([("range", pa.int64()), ("begin", pa.int64()), ("n", pa.int64()), ("clients", pa.binary()), ("times", pa.binary()), ("types", pa.binary()), ("names", pa.list_(pa.string()))])
    part, begin, held = TaskContext.get().partitionId(), 0, []

    def run(rows: pa.Table) -> pa.RecordBatch:
        coded = rows.column("type").combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        one = {"range": part, "begin": begin, "n": rows.num_rows, "clients": rows.column("client").to_numpy().tobytes(), "times": rows.column("t").to_numpy().tobytes(), "types": codes.tobytes(), "names": coded.dictionary.to_pylist()}
        return pa.RecordBatch.from_pylist([one], schema)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < most:
            continue
        rows, at = pa.Table.from_batches(held), 0
        while rows.num_rows - at >= most:
            yield run(rows.slice(at, most))
            begin, at = begin + most, at + most
        held = rows.slice(at).to_batches()
    rows = pa.Table.from_batches(held) if held else None
    if rows is not None and rows.num_rows:
        yield run(rows)


def join_runs(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """A row for each tile from its parts of runs in order, and which of its events a tile before may need: its first client's, or where it has no other, those within `span` of its start."""
    schema = pa.schema([("tile", pa.int64()), ("client_from", pa.int64()), ("t_from", pa.int64()), ("client_to", pa.int64()), ("t_to", pa.int64()), ("clients", pa.binary()), ("times", pa.binary()), ("types", pa.binary()), ("names", pa.list_(pa.string())), ("near_t", pa.list_(pa.int64())), ("near_type", pa.list_(pa.string()))])

    def tile(rows: list[dict]) -> pa.RecordBatch:
        client, t = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in ("clients", "times"))
        known: dict[str, int] = {}
        codes = np.concatenate([np.array([known.setdefault(x, len(known)) for x in r["names"]], np.int32)[np.frombuffer(r["types"], np.int32)] for r in rows])
        names = list(known)
        near = int(np.searchsorted(client, client[0], "right") if client[0] != client[-1] else np.searchsorted(t, t[0] + span, "right"))
        one = {"tile": rows[0]["tile"], "client_from": client[0], "t_from": t[0], "client_to": client[-1], "t_to": t[-1], "clients": client.tobytes(), "times": t.tobytes(), "types": codes.tobytes(), "names": names, "near_t": t[:near], "near_type": [names[k] for k in codes[:near]]}
        return pa.RecordBatch.from_pylist([one], schema)

    held: list[dict] = []
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if held and held[0]["tile"] != row["tile"]:
                yield tile(held)
                held = []
            held.append(row)
    if held:
        yield tile(held)


def enumerate_tile(client: np.ndarray, t: np.ndarray, code: np.ndarray, own: int, longest: int, gap: int, span: int) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """(pattern, places where an occurrence that starts among the first `own` events ends) for each pattern of up to `longest` codes.

    Of the occurrences that end at one event only the latest start matters, and of the earlier ends the latest: it has the
    latest start too, so it satisfies both bounds if any does. So each event is looked at once for each pattern that ends
    within `gap` before it. Events are in order of client and time; those from `own` on are the halo.
    """
    n = len(t)
    # one axis for all clients, on which nothing is further from the event before than just beyond the span
    step = np.where(client[1:] == client[:-1], np.minimum(np.diff(t), span + 1), span + 1)
    axis = np.r_[0, np.cumsum(step)]
    after = np.searchsorted(axis, axis, "right")
    until = np.searchsorted(axis, axis + gap, "right")
    kinds = range(int(code.max()) + 1)
    level = []
    for y in kinds:
        ends = np.flatnonzero(code[:own] == y)
        if len(ends):
            level.append(((y,), ends, axis[ends]))
            yield (y,), ends
    for _ in range(longest - 1):
        following = []
        for pattern, ends, starts in level:
            first = after[ends]
            stop = np.minimum(until[ends], np.r_[first[1:], n])
            count = np.maximum(stop - first, 0)
            at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            begun = np.repeat(starts, count)
            right = axis[at] - begun <= span
            at, begun = at[right], begun[right]
            own_code = code[at]
            for y in kinds:
                hit = np.flatnonzero(own_code == y)
                if len(hit):
                    longer = (*pattern, y)
                    following.append((longer, at[hit], begun[hit]))
                    yield longer, at[hit]
        level = following


def mine_tiles(batches: Iterator[pa.RecordBatch], longest: int, gap: int, span: int) -> Iterator[pa.RecordBatch]:
    """What each tile supports: sums over the clients that are whole in it, and a row for each pattern of those that are cut."""
    schema = pa.schema([("types", pa.list_(pa.string())), ("client", pa.int64()), ("support", pa.int64()), ("crc", pa.int64())])
    for batch in batches:
        for row in batch.to_pylist():
            client, t = (np.frombuffer(row[c], np.int64) for c in ("clients", "times"))
            names, code = list(row["names"]), np.frombuffer(row["types"], np.int32)
            halo = sorted((e["t"], e["type"]) for e in row["halo"] or ())
            if row["first"] == "away":
                client, t, code = (x[np.searchsorted(client, client[0], "right") :] for x in (client, t, code))
            own = len(t) + (len(halo) if row["last"] == "takes" else 0)
            known = {x: k for k, x in enumerate(names)}
            more = np.array([known.setdefault(x, len(known)) for _, x in halo], np.int32)
            names = list(known)
            client = np.r_[client, np.full(len(halo), client[-1])]
            t = np.r_[t, np.array([x for x, _ in halo], np.int64)]
            code = np.r_[code, more]
            border = np.flatnonzero(np.r_[True, client[1:] != client[:-1]])
            who = np.repeat(np.arange(len(border)), np.diff(np.r_[border, len(client)]))
            cut = {p for p, state in ((0, row["first"]), (len(border) - 1, row["last"])) if state == "cut"}
            crc = pa.array(client[border]).cast(pa.string()).to_pylist()
            crc = np.array([zlib.crc32(x.encode()) for x in crc], np.int64)
            out: dict[str, list] = {k: [] for k in schema.names}

            def add(pattern, people, out=out, names=names, cut=cut, crc=crc, client=client, border=border):
                torn = np.isin(people, list(cut))
                inner = people[~torn]
                types = [names[k] for k in pattern]
                if len(inner):
                    for k, v in zip(schema.names, (types, None, len(inner), int(crc[inner].sum())), strict=True):
                        out[k].append(v)
                for p in people[torn]:
                    for k, v in zip(schema.names, (types, int(client[border[p]]), 1, int(crc[p])), strict=True):
                        out[k].append(v)

            add((), np.arange(len(border)))
            for pattern, ends in enumerate_tile(client, t, code, own, longest, gap, span):
                people = who[ends]
                add(pattern, people[np.r_[True, people[1:] != people[:-1]]])
            yield pa.RecordBatch.from_pydict(out, schema)


def sequence_patterns(events: DataFrame, longest: int = 4, gap_us: int = 300 * SECOND, span_us: int = 450 * SECOND, min_clients: int = 2, min_percent: int = 3, tile_events: int = TILE_EVENTS) -> DataFrame:
    """Patterns of 1 to `longest` types that enough clients support: pattern, length, support, clients_crc, n_wider, closed.

    `events` has client, t (microseconds) and type. A client supports a pattern if it has events of these types in order, each
    after the one before by more than 0 and at most `gap_us`, the last at most `span_us` after the first. Kept are patterns of
    `min_clients` clients at least and `min_percent` percent of the clients that have events.

    Spark ranges the events by client and time and numbers them in that order; each `tile_events` of them are a tile, so that a
    long timeline is cut into as many tiles as it fills, wherever these lie; a short one that lies on a border goes whole to the tile where it begins. A cut
    one's tile has as its halo what follows its last event within the span, be it in the next tile or in several; tiles meet
    their halos by client and time slot. Each task enumerates the occurrences that start in a tile. Clients whole in one tile
    are summed there; those of cut timelines become distinct (client, pattern) rows first. Nothing but sums by pattern is gathered. Work grows with the patterns that occur, so types should be a vocabulary.

    Events without client, time or type are left out; repeated ones and ties count once, as a pattern never pairs equal
    times. An empty table gives an empty one.
    """
    spark = prepare(events.sparkSession)
    slot = lambda t: F.floor(t / span_us).cast("long")
    got = events.select("client", "t", "type").where("client is not null and t is not null and type is not null")
    count = max(1, -(-got.count() // tile_events))
    ranged = got.repartitionByRange(count, "client", "t").sortWithinPartitions("client", "t", "type")
    runs = work_table(spark, ranged.mapInArrow(lambda it: cut_runs(it, tile_events), _RUNS), "runs")

    # tiles are cut by place in the order of all events, as each repeats the sums by pattern: however many ranges there are, tiles are full
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = runs.groupBy("range").agg(F.sum("n").alias("n")).select("range", before.alias("offset"))  # a row a range
    placed = runs.join(F.broadcast(offsets), "range").withColumn("begin", F.col("begin") + F.col("offset"))
    parts = placed.withColumn("tile", F.explode(F.expr(f"sequence(begin div {tile_events}, (begin + n - 1) div {tile_events})")))
    parts = parts.withColumns({"a": F.expr(f"int(greatest(tile * {tile_events} - begin, 0))"), "b": F.expr(f"int(least((tile + 1) * {tile_events} - begin, n))")})
    parts = parts.select("tile", "begin", *(F.expr(f"substring({c}, {w} * a + 1, {w} * (b - a))").alias(c) for c, w in (("clients", 8), ("times", 8), ("types", 4))), "names")
    tiles = work_table(spark, parts.repartition(count, "tile").sortWithinPartitions("tile", "begin").mapInArrow(lambda it: join_runs(it, span_us), _TILES), "tiles")
    drop_table(spark, runs)

    # a tile of several clients ends its first one's timeline and begins its last one's; a tile of one is in the midst of a long one
    single = F.col("client_from") == F.col("client_to")
    role = lambda client, name: F.struct(F.col(client).alias("client"), F.lit(name).alias("role"))
    roles = tiles.select("tile", F.explode(F.when(single, F.array(role("client_from", "inside"))).otherwise(F.array(role("client_from", "ends"), role("client_to", "begins")))).alias("e")).select("tile", "e.*")
    at = lambda name: F.min(F.when(F.col("role") == name, F.col("tile")))
    clients = roles.groupBy("client").agg(at("begins").alias("begins"), at("ends").alias("ends"), at("inside").isNotNull().alias("long"))
    firsts = clients.select(F.col("client").alias("client_from"), F.when(F.col("long"), "cut").when(F.col("begins").isNotNull(), "away").otherwise("whole").alias("first"), F.col("begins").alias("home"))
    lasts = clients.select(F.col("client").alias("client_to"), F.when(F.col("long"), "cut").when(F.col("ends").isNotNull(), "takes").otherwise("whole").alias("last"))
    narrow = tiles.select("tile", "client_from", "client_to", "t_to")
    states = narrow.where(~single).join(firsts.hint("merge"), "client_from").join(lasts.hint("merge"), "client_to").unionByName(narrow.where(single).withColumns({"first": F.lit("cut"), "last": F.lit("cut")}), allowMissingColumns=True)
    states = work_table(spark, states, "tile-states")

    near = tiles.select("tile", "t_from", F.arrays_zip("near_t", "near_type").alias("e")).join(states.select("tile", "client_from", "first", "home").hint("merge"), "tile")
    event = lambda x: F.struct(x["near_t"].alias("t"), x["near_type"].alias("type"))
    taken = near.where("first = 'away'").select(F.col("home").alias("tile"), F.transform("e", event).alias("halo"))
    early = near.where("first = 'cut'").select(F.col("tile").alias("from"), F.col("client_from").alias("client"), "t_from", F.explode("e").alias("e")).select("from", "client", event(F.col("e")).alias("e"), slot(F.col("e.near_t")).alias("slot")).where(F.col("e.t") <= F.col("t_from") + span_us)
    ends = states.where("last = 'cut'").select("tile", F.col("client_to").alias("client"), "t_to", F.explode(F.array(slot(F.col("t_to")), slot(F.col("t_to")) + 1)).alias("slot"))
    met = early.join(ends.hint("merge"), ["client", "slot"]).where((F.col("from") > F.col("tile")) & F.col("e.t").between(F.col("t_to"), F.col("t_to") + span_us))
    halos = met.groupBy("tile").agg(F.collect_set("e").alias("halo")).unionByName(taken)
    whole = tiles.select("tile", "clients", "times", "types", "names").join(states.select("tile", "first", "last").hint("merge"), "tile").join(halos.hint("merge"), "tile", "left")

    found = work_table(spark, whole.mapInArrow(lambda it: mine_tiles(it, longest, gap_us, span_us), _FOUND), "patterns")
    inner = found.where("client is null").groupBy("types").agg(F.sum("support").alias("support"), F.sum("crc").alias("crc"))
    cut = found.where("client is not null").select("types", "client", "crc").distinct().groupBy("types").agg(F.count(F.lit(1)).alias("support"), F.sum("crc").alias("crc"))
    sums = inner.unionByName(cut).groupBy("types").agg(F.sum("support").alias("support"), F.sum("crc").alias("crc"))
    people = sums.where(F.size("types") == 0).select(F.col("support").alias("people"))
    kept = sums.where(F.size("types") > 0).join(F.broadcast(people)).where((F.col("support") >= min_clients) & (100 * F.col("support") >= min_percent * F.col("people"))).select("types", "support", "crc")
    kept = work_table(spark, kept, "kept-patterns")

    masks = F.sequence(F.lit(1).cast("long"), F.pow(F.lit(2), F.size("types")).cast("long") - 2)
    part = F.transform(masks, lambda m: F.filter("types", lambda x, i: F.getbit(m, i) == 1))
    parts = kept.where(F.size("types") > 1).select("support", F.explode(F.array_distinct(part)).alias("types"))
    wider = parts.groupBy("types", "support").agg(F.count(F.lit(1)).alias("n_wider"))
    n = F.coalesce("n_wider", F.lit(0)).cast("long")
    return kept.join(wider.hint("merge"), ["types", "support"], "left").select(F.array_join("types", ">").alias("pattern"), F.size("types").alias("length"), "support", F.col("crc").alias("clients_crc"), n.alias("n_wider"), (n == 0).alias("closed"))
