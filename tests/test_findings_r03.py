"""What the third round's findings were about, each by a table on which it failed."""

import hashlib
import html
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.llm import sequence_patterns as patterns
from quern.llm._common import work_table
from quern.llm.sequence_patterns import sequence_patterns
from quern.operators import stats, structure, summaries, vectors
from quern.plans.catalog import queries
from tests.llm.test_tiles_suffixes_turns import closed_patterns


def test_patterns_of_tiles_from_many_ranges(spark):
    """Fewer tiles than shuffle partitions, none of which is merged for being small."""
    r = random.Random(5)
    events = [(r.choice([1, 1, 1, 2, 3, 4, 5, 6]), r.randrange(0, 9000, 5), r.choice("abc")) for _ in range(600)]
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        frame = spark.createDataFrame(events, "client long, t long, type string").repartition(6)
        assert {tuple(x) for x in sequence_patterns(frame, 3, 60, 90, 2, 3, 200).collect()} == closed_patterns(events, 3, 60, 90, 2, 3)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_patterns_of_full_tiles(spark, monkeypatch):
    """However many ranges Spark makes, tiles are full, so the sums by pattern are not repeated for small ones."""
    r = random.Random(6)
    events = [(r.choice([1, 1, 1, 2, 3, 4, 5, 6]), r.randrange(0, 9000, 5), r.choice("abc")) for _ in range(600)]
    frame = spark.createDataFrame(events, "client long, t long, type string").repartition(6)
    ranged, kept = type(frame).repartitionByRange, {}
    monkeypatch.setattr(type(frame), "repartitionByRange", lambda self, n, *by: ranged(self, 37, *by))
    monkeypatch.setattr(patterns, "work_table", lambda s, df, name: kept.setdefault(name, work_table(s, df, name)))
    assert {tuple(x) for x in sequence_patterns(frame, 3, 60, 90, 2, 3, 100).collect()} == closed_patterns(events, 3, 60, 90, 2, 3)
    assert [len(x.clients) // 8 for x in kept["tiles"].collect()] == [100] * 6


def test_summaries_are_normalised_once(spark):
    d = spark.createDataFrame([("{}", "7")], "p string, i string")
    none = F.lit(None).cast("string")
    checked = d.select(summaries.summary_check(F.col("p"), F.col("i"), F.col("i"), none, none).alias("c")).select("c.*")
    easy = d.select(summaries.easy_summary_check(F.col("p"), F.col("i")).alias("c")).select("c.*")
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert plan(checked).count("_unescaped(") <= 4
    assert plan(easy).count("\\n{2,}") == 1


def test_discovery_order_rounds_halves_to_even(spark, tmp_path):
    for name, rows, schema in (
        ("customer", [(1, "a", 2.5), (2, "b", 2.4), (3, "c", -0.5), (4, "d", 0.2)], "c_custkey long, c_name string, c_acctbal double"),
        ("orders", [(9, "P")], "o_custkey long, o_orderstatus string"),
        ("supplier", [("x",)], "s_name string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = queries()["discovery_order"](spark, str(tmp_path)).orderBy("place")
    assert [r.id for r in got.collect()] == [1, 2, 3, 4]
    rows = [(1, "a", 3.5), (2, "a", 4.5)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_acctbal double").write.mode("overwrite").parquet(f"{tmp_path}/customer.parquet")
    assert [r.id for r in queries()["discovery_order"](spark, str(tmp_path)).orderBy("place").collect()] == [1, 2]  # both 4


def test_markup_of_open_references(spark, tmp_path):
    spark.createDataFrame([(1, "a&amp<p>b&amp;c&copy d&nbsp;e")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries()["markup_normalise"](spark, str(tmp_path)).first()
    assert got.body.endswith(" xa&amp b&c&copy d e")
    assert spark.range(1).select(T.entities(F.lit("a&amp b"))).first()[0] == "a& b"


def test_neighbours_in_parts(spark, monkeypatch):
    """Vectors come in parts of a task's distances; ties at the last place, copies and a vector without direction included."""
    r = random.Random(3)
    rows = [(i, [float(r.randrange(-2, 3)) for _ in range(3)]) for i in range(300)]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if any(v)}
    want = set()
    for q in range(0, 300, 20):
        near = sorted((round(1 - float(unit[q] @ v), 6) + 0.0, i) for i, v in unit.items() if i != q)[:7] if q in unit else []
        want |= {(q, i, d, k) for k, (d, i) in enumerate(near, 1)}
    d = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    monkeypatch.setattr(vectors, "CELLS", 60)
    got = vectors.knn(d, d.where("id % 20 = 0"), 7).collect()
    assert {(x.query_id, x.id, x.distance, x["rank"]) for x in got} == want


def test_labels_by_kind(spark, tmp_path):
    """Labels counted by kind are those paired one by one; unknown ids are found, and no table of pairs is made for the others."""
    rows = [(i, [1.0, float(i)], i * 7 % 4) for i in range(90)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i,) for i in range(90) if i not in (33, 34)], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    from quern.plans import trials  # needs the catalog first

    label, pairs = {i: x for i, _, x in rows}, {}
    for q in range(0, 90, 20):
        for i in range(90):
            gap = abs(label[i] - label[q])
            if i != q and gap < 2:
                pairs[q, i] = {"majority": 3 - 2 * gap, "independent": 0 if i % 3 == 0 else 2 if i % 5 == 0 else 3 - 2 * gap}
    one = {(r.policy, r.query_id, r.id, r.grade) for r in trials.policies(spark, str(tmp_path)).collect()}
    assert one == {(p, q, i, g) for (q, i), x in pairs.items() for p, g in x.items()}
    counted = Counter()
    for r in trials.counted_policies(spark, str(tmp_path)).collect():
        counted[r.policy, r.query_id, r.grade] += r.n
    assert counted == Counter((p, q, g) for p, q, _, g in one)
    got = sorted((r.fault, r.query_id, r.id) for r in queries()["label_faults"](spark, str(tmp_path)).collect())
    assert got == sorted(("unknown_label", str(q), str(i)) for q, i in pairs if i in (33, 34))


def test_long_texts_stay_in_arrow(spark):
    """A batch is turned into Python strings in parts; results are those of each text, nulls and batches beyond a part included."""
    texts = [None if i % 50 == 0 else "가나 &amp; 다. " * (i % 40) + ("\n판사 홍길동" if i % 3 == 0 else "") for i in range(3 * T.PART + 5)]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = d.select("i", T.entities(F.col("t")).alias("e"), structure.packed("t").alias("p"), structure.signatures_cut("t").alias("s")).orderBy("i").collect()
    assert [(r.e, r.p, tuple(r.s)) for r in got] == [(t and html.unescape(t), structure.pack(t or ""), structure.without_signatures(t or "")) for t in texts]


def test_corpus_digest_is_taken_up_by_each_range(spark):
    texts = [(i, "é" * (i % 90) + str(i)) for i in range(700)]
    d = spark.createDataFrame(texts, "k long, t string").repartition(3)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sent = []
    try:
        with pytest.MonkeyPatch.context() as m:
            m.setattr(DataFrame, "toLocalIterator", lambda *a, **k: sent.append(a))
            assert stats.corpus_digest(d, ["k"], F.col("t")) == (700, hashlib.sha256("\n".join(t for _, t in texts).encode()).hexdigest())
            assert stats.corpus_digest(d.where("false"), ["k"], F.col("t")) == (0, hashlib.sha256().hexdigest())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert not sent


def test_search_holds_no_more_for_more_vectors(spark):
    """What a task's Python holds at most doesn't grow with the queries of a block and the vectors that the task meets."""
    import tracemalloc

    import pyarrow as pa

    class Rows:
        """A table as near() sees it: it gives the function that the tasks would run."""

        def __init__(self, n):
            self.n = n

        def where(self, *_):
            return self

        select = where

        def toLocalIterator(self):
            return iter([(i, [float(x) for x in unit[i]]) for i in range(self.n)])

        def mapInArrow(self, run, schema):
            return run

    unit = np.random.default_rng(1).normal(size=(16_000, 8))
    peaks = []
    for n, queries in ((4_000, 500), (16_000, 2_000)):
        batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + 4_000)), pa.array(list(unit[at : at + 4_000]))], names=["id", "vector"]) for at in range(0, n, 4_000)]
        run = vectors.near(Rows(n), Rows(queries), 10)
        tracemalloc.start()
        assert sum(b.num_rows for b in run(iter(batches))) == 10 * queries
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert peaks[1] < 1.3 * peaks[0], peaks
