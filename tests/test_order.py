"""Order-dependent operators against plain loops: a key with most rows, ties, borders everywhere; streams against tables."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import order as O
from quern.operators.generation import FAILED, GENERATED, GENERATING, generation


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables in as many ranges as large ones."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbered(spark):
    rows = [(random.Random(i).random(), i) for i in range(500)]
    df = spark.createDataFrame(rows, "x double, i long").repartition(7)
    want = {i: k + 1 for k, (_, i) in enumerate(sorted(rows, key=lambda r: -r[0]))}
    assert {r.i: r.place for r in O.numbered(df, [F.desc("x"), F.col("i")]).collect()} == want
    assert O.numbered(df.where("false"), ["i"]).collect() == []
    got = O.accumulated(df, ["i"], total=("sum", F.col("i")), top=("max", F.when(F.col("i") % 100 == 7, F.col("i")))).collect()
    assert all(r.total == r.i * (r.i + 1) // 2 for r in got)
    assert all(r.top == ((r.i - 7) // 100 * 100 + 7 if r.i >= 7 else None) for r in got)


def plain_states(actions):
    state, out = 0, []
    for a in actions:
        asked = "in_progress" if state == GENERATING else "idempotent" if state == GENERATED else None
        if a in ("start", "request"):
            out.append((state, asked or ("started" if a == "start" else "generated")))
            state = state if asked else GENERATING if a == "start" else GENERATED
        elif a in ("complete", "fail"):
            out.append((state, "completed" if a == "complete" else "failed"))
            state = GENERATED if a == "complete" else FAILED
        else:
            out.append((state, "none"))
    return out


def acted(n, seed=0):
    r = random.Random(seed)
    return [(r.choice([7, 7, 7, 7, 1, 2, 3, None]), i, r.choice(["start", "start", "request", "complete", "fail", "none", None])) for i in range(n)]


def test_generation(spark):
    got = generation(spark.createDataFrame([(1, 1, "request"), (1, 2, "none"), (1, 3, "request")], "u long, i long, action string"), "u", "i")
    assert [r.transition for r in got.orderBy("i").collect()] == ["generated", "none", "idempotent"]
    rows = acted(3000)
    got = {(r.u, r.i): (r.state, r.transition) for r in generation(spark.createDataFrame(rows, "u long, i long, action string").repartition(5), "u", "i").collect()}
    want = {}
    for u in {u for u, _, _ in rows}:
        mine = [(i, a) for v, i, a in rows if v == u]
        want |= {(u, i): x for (i, _), x in zip(mine, plain_states([a for _, a in mine]), strict=True)}
    assert got == want


def test_hot_key_is_many_blocks(spark):
    """A key with all rows is dealt out to as many tasks as there are ranges."""
    hot = spark.range(20_000).selectExpr("1 as u", "id as i")
    assert O.blocked(hot.repartition(8), ["u", "i"]).select("_block").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_generation_stream(spark, tmp_path):
    from quern.streaming.state import generation_stream

    rows = [r for r in acted(400, 1) if r[0] is not None]
    for k in range(4):
        spark.createDataFrame(rows[k * 100 : (k + 1) * 100], "u long, i long, action string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = generation_stream(spark.readStream.schema("u long, i long, action string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "u", "i")
        run = got.writeStream.format("memory").queryName("explained").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    batch = generation(spark.createDataFrame(rows, "u long, i long, action string"), "u", "i")
    columns = ["u", "i", "state", "transition"]
    assert sorted(spark.table("explained").select(*columns).collect()) == sorted(batch.select(*columns).collect())


@pytest.mark.parametrize("bucket", [4, 4096])
def test_reached(spark, bucket):
    r = random.Random(bucket)
    n, to = 300, []
    for i in range(n):
        to.append(max(to[-1] if to else 0, min(n, i + 1 + r.choice([0, 0, 1, 5, 40]))))
    want, i = [], 0
    while i < n:
        want.append(i)
        i = to[i]
    got = O.reached(spark.createDataFrame(list(enumerate(to)), "at long, next long"), bucket)
    assert sorted(x.at for x in got.collect()) == want
    assert O.reached(spark.createDataFrame([], "at long, next long"), bucket).count() == 0


def test_batches(spark):
    r = random.Random(3)
    sizes = [r.choice([0, 0, 1, 5, 30, 100]) for _ in range(600)]
    want, items, total, batch = [], 0, 0, 1
    for n in sizes:
        if items and (items >= 7 or total + n > 100):
            items, total, batch = 0, 0, batch + 1
        items, total = items + 1, total + n
        want.append(batch)
    df = spark.createDataFrame(list(enumerate(sizes)), "i long, n long").repartition(5)
    assert [x.batch for x in O.greedy_batches(df, ["i"], F.col("n"), 7, 100).orderBy("i").collect()] == want
    with pytest.raises(Exception, match="larger than 99"):
        O.greedy_batches(df, ["i"], F.col("n"), 7, 99).collect()


def test_sessions(spark):
    r = random.Random(4)
    rows = sorted({(r.choice([7, 7, 7, 1, 2]), r.randrange(3000), i) for i in range(500)})
    want, now, opened, n = {}, None, 0, 0
    for u, t, i in rows:
        if u != now:
            now, opened, n = u, t, 1
        elif opened + 30 <= t:
            opened, n = t, n + 1
        want[u, i] = n
    df = spark.createDataFrame(rows, "u long, t long, i long").repartition(5)
    assert {(x.u, x.i): x.session for x in O.greedy_sessions(df, "u", F.col("t"), "i", 30).collect()} == want


def test_evicted(spark):
    r = random.Random(5)
    opens = [(i, r.randrange(1000)) for i in range(300)]
    store, ended = {}, {}
    for i, t in sorted(opens, key=lambda x: (x[1], x[0])):
        for j in [j for j, e in store.items() if e <= t]:
            ended[j] = (store.pop(j), False)
        while len(store) >= 20:
            oldest = next(iter(store))
            store.pop(oldest)
            ended[oldest] = (t, True)
        store[i] = t + 90
    ended |= {j: (e, False) for j, e in store.items()}
    got = O.evicted(spark.createDataFrame(opens, "i long, t long"), ["t", "i"], F.col("t"), 90, 20)
    assert {x.i: (x.ends, x.evicted) for x in got.collect()} == ended
