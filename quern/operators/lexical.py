"""Lexical scoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Distinct query tokens that one search takes; scores [document, query] that are held at a time.
MOST_TOKENS, CELLS = 1_000_000, 4_000_000


def bm25(queries: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75, pairs: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score) of documents that share a token with a query; tables (.._id, tokens: array).

    idf is ln(1 + (N - df + .5) / (df + .5)); a token counts as often as the query has it. Only tokens of queries travel:
    documents are cut down to them before the join. A document that shares none has score 0 and is not listed.
    With `pairs` (query_id, doc_id) only these are scored, by the statistics of all documents.
    """
    sized = docs.select("doc_id", "tokens", F.size("tokens").alias("n"))
    total = sized.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"))
    q = queries.select("query_id", F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qf"))
    wanted = q.select("token").distinct()
    tf = sized.select("doc_id", "n", F.explode("tokens").alias("token")).join(wanted, "token", "left_semi").groupBy("token", "doc_id", "n").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    if pairs is not None:
        tf = tf.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    d = tf.join(df, "token").join(F.broadcast(total))  # one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    met = d.select("token", "doc_id", weight.alias("w")).join(q, "token")
    if pairs is not None:
        met = met.join(pairs.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    return met.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("qf")), 6).alias("score"))


def best_bm25(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank): the k documents of each query that bm25() scores best, then by id; zero scores count.

    Queries are a stated set: their tokens, of a checked number, and these tokens' document frequencies go to all tasks. A
    task scores its documents against all queries in blocks and passes on its k best of each query alone.
    """
    spark = docs.sparkSession
    q = queries.select("query_id", F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qf"))
    wanted = q.select("token").distinct()
    if wanted.count() > MOST_TOKENS:
        raise ValueError(f"more than {MOST_TOKENS} query tokens: search in blocks of queries")
    n_docs, mean = docs.agg(F.count(F.lit(1)), F.avg(F.size("tokens"))).first()
    df = docs.select(F.explode(F.array_distinct("tokens")).alias("token")).join(F.broadcast(wanted), "token").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rows = df.collect()
    known = {r["token"]: i for i, r in enumerate(rows)}
    idf = np.array([np.log(1 + (n_docs - r["df"] + 0.5) / (r["df"] + 0.5)) for r in rows])
    ids = sorted(r[0] for r in queries.select("query_id").distinct().collect())
    place = {x: i for i, x in enumerate(ids)}
    pairs = sorted((known[r["token"]], place[r["query_id"]], r["qf"]) for r in q.collect() if r["token"] in known)
    token, query, times = (np.array(c, np.int64) for c in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64),) * 3
    sent = spark.sparkContext.broadcast((known, idf, np.searchsorted(token, np.arange(len(known) + 1)), query, times, np.array(ids, np.int64)))
    schema = "query_id long, doc_id long, score double"
    if not ids or not n_docs:
        return spark.createDataFrame([], schema + ", rank int")

    def run(batches) -> Iterator[pa.RecordBatch]:
        known, idf, first, query, times, ids = sent.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * len(ids)
        step = max(1, CELLS // len(ids))
        for batch in batches:
            for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                lists = part.column(1)
                size = np.array(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
                coded = lists.flatten().dictionary_encode()
                names = np.array([known.get(t, -1) for t in coded.dictionary.to_pylist()], np.int64)
                word = names[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.int64)
                doc = np.repeat(np.arange(len(size)), size)
                key, tf = np.unique(doc[word >= 0] * max(1, len(known)) + word[word >= 0], return_counts=True)
                doc, word = key // max(1, len(known)), key % max(1, len(known))
                weight = idf[word] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[doc] / mean))
                n = first[word + 1] - first[word]
                at = np.repeat(first[word] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
                scores = np.bincount(np.repeat(doc, n) * len(ids) + query[at], np.repeat(weight, n) * times[at], len(size) * len(ids)).reshape(len(size), len(ids)).round(6)
                own = part.column(0).to_numpy(zero_copy_only=False)
                for i in range(len(ids)):
                    s, d = np.concatenate([best[i][0], scores[:, i]]), np.concatenate([best[i][1], own])
                    top = np.lexsort((d, -s))[:k]
                    best[i] = s[top], d[top]
        for i, (s, d) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), ids[i])), pa.array(d.astype(np.int64)), pa.array(s)], names=["query_id", "doc_id", "score"])

    found = docs.select(F.col("doc_id").cast("long"), "tokens").mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
