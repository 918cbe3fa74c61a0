"""Vector search: exact nearest neighbours of a stated query set, and what rankings are made into."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that one pass over the vectors takes; more queries are as many passes.
BLOCK = 4096
#: Distances that a task has at a time: vectors are taken in parts, so that its memory doesn't grow with the queries.
CELLS = 500_000


def knn(vectors: DataFrame, queries: DataFrame, k: int, low: int = 0, high: int | None = None, keep_self: bool = False) -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest vectors by cosine distance (6 places), ties by id."""
    return top(near(vectors, queries, k, low, high, keep_self), ["query_id"], k, F.col("distance"), F.col("id"))


def near(vectors: DataFrame, queries: DataFrame, k: int, low: int = 0, high: int | None = None, keep_self: bool = False) -> DataFrame:
    """(query_id, id, distance): the k nearest of each query in each task's vectors, of which top() makes the k nearest of all.

    Both sides have columns id and vector. Queries come to the driver in blocks and go out with the tasks; each task keeps its
    own k best of each query, so a row for each query, task and place is all that is shuffled. A task holds CELLS distances and
    its k best of a block's queries at a time. Dimensions low..high count.
    Rows without a vector are left out.
    """
    found = None
    block: list = []

    def search(rows: list) -> DataFrame:
        ids = np.array([r[0] for r in rows])
        q = np.array([r[1] for r in rows], np.float64)[:, low:high]
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        step = max(1, CELLS // len(ids))

        def run(batches) -> Iterator[pa.RecordBatch]:
            best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            bound, held, waiting = np.full(len(ids), np.inf), [], 0

            def nearest(rows: list) -> tuple:
                """The k nearest of each query among (place of the query, id, distance), in order."""
                at, own, far = (np.concatenate(x) for x in zip(*rows, strict=True))
                order = np.lexsort((own, far, at))
                at, own, far = at[order], own[order], far[order]
                begin = np.searchsorted(at, np.arange(len(ids)))
                ok = np.arange(len(at)) - begin[at] < k
                full = np.diff(np.r_[begin, len(at)]) >= k
                bound[full] = far[begin[full] + k - 1]
                return at[ok], own[ok], far[ok]

            for batch in batches:
                for low_row in range(0, batch.num_rows, step):
                    part = batch.slice(low_row, step)
                    own = part.column(0).to_numpy()
                    v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1).astype(np.float64)[:, low:high]
                    far = np.round(1 - q @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T, 6) + 0.0
                    if not keep_self:
                        far[ids[:, None] == own[None, :]] = np.inf
                    # what is no nearer than k others that are known can be left out at once
                    at, place = np.nonzero((far <= bound[:, None]) & np.isfinite(far))
                    held.append((at, own[place], far[at, place]))
                    waiting += len(at)
                    if waiting >= CELLS:
                        best, held, waiting = nearest([best, *held]), [], 0
            at, own, far = nearest([best, *held])
            for start in range(0, len(at), CELLS):
                rows = slice(start, start + CELLS)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[rows]]), pa.array(own[rows]), pa.array(far[rows])], names=["query_id", "id", "distance"])

        return vectors.where("vector is not null").select(F.col("id").cast("long"), "vector").mapInArrow(run, "query_id long, id long, distance double")

    for r in queries.where("vector is not null").select(F.col("id").cast("long"), "vector").toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            found, block = (search(block) if found is None else found.union(search(block))), []
    if block or found is None:
        part = search(block) if block else vectors.sparkSession.createDataFrame([], "query_id long, id long, distance double")
        found = part if found is None else found.union(part)
    return found


def top(df: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group with their rank from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def document_of(precedent_id: Column, source_case_id: Column, chunk_id: Column) -> Column:
    """The document of a chunk: its precedent_id, else its source_case_id, else what its id precedent:{id}:.. names; null without any."""
    given = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    return F.coalesce(given(precedent_id), given(source_case_id), F.nullif(F.regexp_extract(chunk_id, "^precedent:([^:]+):", 1), F.lit("")))


def group_hits(hits: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Hits (.., document, id, distance, rank) as documents: best distance and chunk, number of chunks, rank 1..k.

    A document stands where its nearest hit does; of equal distances the earlier hit. Hits without a document are skipped.
    """
    by = by or ["query_id"]
    best = F.min(F.struct("distance", "rank", "id"))
    docs = hits.where("document is not null").groupBy(*by, "document").agg(best.alias("best"), F.count(F.lit(1)).alias("matched_chunks"), F.min("rank").alias("first_rank"))
    docs = docs.select(*by, "document", "matched_chunks", F.col("best.distance").alias("best_distance"), F.col("best.id").alias("best_chunk"), "first_rank")
    return top(docs, by, k, F.col("best_distance"), F.col("first_rank"), F.col("document")).drop("first_rank")


def collapse_to_parent(hits: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The best-ranked child of each parent (.., parent, id, distance, rank), ranked anew 1..k."""
    by = by or ["query_id"]
    first = top(hits.withColumnRenamed("rank", "child_rank"), [*by, "parent"], 1, F.col("child_rank")).drop("rank")
    return top(first, by, k, F.col("child_rank"))


def pool(rankings: DataFrame, k: int) -> DataFrame:
    """Candidates (query_id, id) that any model ranks up to k: best rank, models, best distance, rank by those.

    Order: best rank, more models, best distance, id.
    """
    got = rankings.where(F.col("rank") <= k).groupBy("query_id", "id").agg(F.min("rank").alias("best_rank"), F.countDistinct("model").alias("models"), F.min("distance").alias("best_distance"))
    order = (F.col("best_rank"), F.desc("models"), F.col("best_distance"), F.col("id"))
    return got.withColumn("pool_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def blind(candidates: DataFrame) -> DataFrame:
    """Adds candidate_id C01, C02, .. in the order of sha256(query NUL id), which hides who found what."""
    key = F.sha2(F.concat(F.col("query_id").cast("string"), F.lit("\0"), F.col("id").cast("string")), 256)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(key))
    return candidates.withColumn("candidate_id", F.concat(F.lit("C"), F.when(place < 100, F.lpad(place.cast("string"), 2, "0")).otherwise(place.cast("string"))))
