"""A store filled by streams that die and writers that meet; an encoder that runs out of memory."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quern.operators.encoding import encoded
from quern.streaming.store import Fenced, Store, fill, sizes

SCHEMA = "id long, x string"


def test_killed_and_resumed(spark, tmp_path):
    for k in range(4):
        spark.range(k * 10, k * 10 + 12).selectExpr("id", "cast(id as string) as x").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def die(batch):
        if batch == 2:
            raise RuntimeError("killed")

    first = Store(spark, f"{tmp_path}/store", SCHEMA, "id")
    with pytest.raises(StreamingQueryException, match="killed"):
        fill(stream(), first, f"{tmp_path}/at", die)
    assert sorted(first.committed()) == [0, 1]
    store = Store(spark, f"{tmp_path}/store", SCHEMA, "id")
    fill(stream(), store, f"{tmp_path}/at")
    source = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in")
    assert store.complete(source) and store.read().count() == 42
    assert sum(r.rows for r in sizes(store).collect()) == 42
    assert not store.complete(source.where("id > 3"))
    assert store.commit(source, 3) is False  # a batch that is replayed
    with pytest.raises(Fenced):
        first.commit(source, 4)
    assert store.complete(source)


def test_two_writers(spark, tmp_path):
    old = Store(spark, f"{tmp_path}/s", SCHEMA, "id")
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], SCHEMA)
    new = []
    with pytest.raises(Fenced):
        old.commit(rows, 0, lambda: new.append(Store(spark, f"{tmp_path}/s", SCHEMA, "id")))
    assert new[0].read().count() == 0 and new[0].commit(rows, 0) and new[0].read().count() == 2


@pytest.mark.parametrize("most", [1, 3, 7, 1000])
def test_encoding(spark, most):
    def make():
        def encode(texts):
            if len(texts) > most:
                raise RuntimeError("CUDA Out Of Memory")
            if "bad" in texts:
                raise MemoryError("bad text")
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    rows = [(i, "bad" if i in (5, 90) else "x" * (i % 13) if i % 11 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    got = encoded(df, "id", "text", make, 2, 16).collect()
    assert [r.id for r in got] == list(range(100))
    assert all((r.embedding, r.error) == ((None, "bad text") if t == "bad" else ([float(len(t or "")), 1.0], None)) for r, (_, t) in zip(got, rows, strict=True))
    with pytest.raises(Exception, match="other than"):
        encoded(df.where("text <> 'bad'"), "id", "text", make, 3).collect()


def test_encoder_failure(spark):
    def make():
        def encode(texts):
            raise RuntimeError("no such model")

        return encode

    with pytest.raises(Exception, match="no such model"):
        encoded(spark.range(2).select("id", F.lit("a").alias("text")), "id", "text", make, 2).collect()
