"""The queries with SQL against DuckDB, and the pipeline against its stages done by hand."""

import hashlib
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quern.llm import queries
from tests.llm.test_ops import base_spans, components, shingle_sets


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, small, name):
    for t in ("documents", "labels", "benchmark", "clicks", "conversations"):
        duckdb.sql(f"create or replace view {t} as select * from '{small}/{t}.parquet'")
    want = duckdb.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, small).toPandas()[list(want.columns)]
    key = list(want.columns)
    assert got.sort_values(key).reset_index(drop=True).equals(want.sort_values(key).reset_index(drop=True).astype(got.dtypes.to_dict()))


def test_pipeline_on_odd_rows(spark, small, tmp_path):
    """Null ids and texts, repeated rows, an extra column with an operator's own name, and tables without a row."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    some = docs.limit(30).collect()
    rows = [*some, some[0], Row(**some[1].asDict() | {"doc_id": None}), Row(**some[2].asDict() | {"doc_id": some[3].doc_id}), Row(**some[4].asDict() | {"doc_id": 10**6, "text": None}), Row(**some[5].asDict() | {"doc_id": 10**6 + 1, "text": ""})]
    frame = spark.createDataFrame(rows, docs.schema).withColumn("content", F.lit(1)).withColumn("label", F.lit("x"))
    for table, want in ((frame, 20), (frame.where("false"), 0)):
        got = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = got
            got = spark.createDataFrame(stage(spark, got, small).collect(), stage(spark, got, small).schema)
            if k < 4:
                assert got.columns == before.columns
                assert {tuple(r) for r in got.collect()} <= {tuple(r) for r in before.collect()}
        assert got.count() >= min(want, 1) and (want or not got.count())


def test_queries_on_odd_rows(spark, small, tmp_path):
    """Every query over a table with null and repeated ids, null and empty texts, and over a table without a row."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    some = docs.limit(40).collect()
    rows = [*some, some[0], Row(**some[1].asDict() | {"doc_id": None}), Row(**some[2].asDict() | {"doc_id": some[3].doc_id}), Row(**some[4].asDict() | {"doc_id": 10**6, "text": None}), Row(**some[5].asDict() | {"doc_id": None, "text": ""})]
    for name, table in (("odd", spark.createDataFrame(rows, docs.schema)), ("empty", docs.where("false"))):
        (tmp_path / name).mkdir()
        for other in Path(small).iterdir():
            if other.name != "documents.parquet":
                (tmp_path / name / other.name).symlink_to(other)
        table.withColumn("content", F.lit(1)).withColumn("unit", F.lit("x")).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        want = sorted((r.doc_id is None, r.doc_id or 0) for r in table.collect())
        for query, run in queries.queries().items():
            if query in ("op11_patterns", "op13_conversation_repair"):  # of other tables
                continue
            got = sorted((r.doc_id is None, r.doc_id or 0) for r in run(spark, f"{tmp_path}/{name}").collect())
            assert got == want or query == "op7_decontamination" and set(got) <= set(want), query


def test_digests_and_spans(spark, small):
    """The digest columns of queries that have no SQL, against the library and plain Python."""
    texts = dict(duckdb.sql(f"select doc_id, text from '{small}/documents.parquet'").fetchall())
    lib = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    start, files = 0, {r.doc_id: r for r in queries.op3_token_files(spark, small).collect()}
    bpe = {r.doc_id: r for r in queries.op4_bpe(spark, small).collect()}
    spans = {r.doc_id: r for r in queries.op9_secrets(spark, small).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for i in sorted(texts):
        ids = lib.encode(texts[i], add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        assert tuple(bpe[i]) == (i, len(ids), hashlib.sha256(raw).hexdigest(), sha(lib.decode(ids, skip_special_tokens=False)))
        assert tuple(files[i]) == (i, start, len(ids) + 1, zlib.crc32(raw + np.array([1], "<u4").tobytes()))
        start += len(ids) + 1
        base = base_spans(texts[i])
        assert (spans[i].n_assign, spans[i].n_access, spans[i].n_hex) == tuple(sum(b[1] == o for b in base) for o in range(3))
        assert spans[i].base_sha256 == sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in base))


def test_held_out_quality_and_language(spark, small):
    """Held-out accuracy on the next larger tables, beyond the share of the commoner label."""
    larger = "/root/testdata/sf0.01"
    label = dict(duckdb.sql(f"select doc_id, quality from '{larger}/labels.parquet'").fetchall())
    got = {r.doc_id: r for r in queries.op5_quality(spark, larger).collect()}
    held = [i for i in label if got[i].held_out]
    assert {i for i in got if zlib.crc32(str(i).encode()) % 4 == 2} == {i for i in got if got[i].held_out}
    right = sum(got[i].predicted == label[i] for i in held) / len(held)
    common = max(sum(label[i] for i in held), sum(1 - label[i] for i in held)) / len(held)
    assert right >= 0.95 and right > common + 0.1
    lang = dict(duckdb.sql(f"select doc_id, lang from '{larger}/documents.parquet' where lang is not null").fetchall())
    said = {r.doc_id: r for r in queries.op2_language_id(spark, larger).collect()}
    held = [i for i in lang if said[i].held_out]
    assert sum(said[i].lang_pred == lang[i] for i in held) >= 0.97 * len(held)


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    label = dict(duckdb.sql(f"select doc_id, quality from '{small}/labels.parquet'").fetchall())
    good = corpus_pipeline.quality(spark, docs, small)
    left = {r.doc_id: r.text for r in good.collect()}
    assert good.columns == docs.columns
    assert sum((i in left) == bool(q) for i, q in label.items()) >= 0.9 * len(label)
    first = {}
    for i in sorted(left):
        first.setdefault(" ".join(left[i].split()), i)
    left = {i: left[i] for i in first.values()}
    near = components(shingle_sets(left, 5), 80, 100)
    left = {i: t for i, t in left.items() if near[i] == i}
    items = [" ".join(t.split()) for (t,) in duckdb.sql(f"select text from '{small}/benchmark.parquet'").fetchall()]
    left = {i: t for i, t in left.items() if not any(x in " ".join(t.split()) for x in items)}
    lib = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, small).collect()}
    assert set(got) == set(left)
    for i, t in left.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids, got[i].decoded) == (len(ids), ids, lib.decode(ids, skip_special_tokens=False))
