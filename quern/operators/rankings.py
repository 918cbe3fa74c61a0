"""Rankings of documents from hits of their chunks, and what reviewers get to see of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.order import numbered


def pooled(hits: DataFrame, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Hits (query, doc, chunk_id, chunk_rank, distance) by document: best rank, best distance and its chunk, and place.

    Order: best rank, best distance (none last), id. Hits without a document are left out.
    """
    g = hits.where(F.col(doc).isNotNull()).groupBy(query, doc).agg(F.min("chunk_rank").alias("best_rank"), F.min("distance").alias("best_distance"), F.min(F.struct(F.coalesce("distance", F.lit(1e9)).alias("d"), "chunk_rank", "chunk_id")).alias("b"), F.count(F.lit(1)).alias("chunks"))
    order = ["best_rank", F.coalesce("best_distance", F.lit(1e9)), doc]
    return g.select(query, doc, "best_rank", "best_distance", F.col("b.chunk_id").alias("best_chunk"), "chunks", F.row_number().over(Window.partitionBy(query).orderBy(*order)).alias("place"))


def reranked(scored: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Chunks (query, doc, doc_rank, chunk_rank, chunk_id, score) by document: its best score (of equal ones the first chunk's),
    best first, equal ones as they were ranked before; the first k."""
    best = scored.groupBy(query, doc).agg(F.min(F.struct((-F.col("score")).alias("s"), "chunk_rank", "chunk_id")).alias("b"), F.min("doc_rank").alias("doc_rank"))
    w = Window.partitionBy(query).orderBy("b.s", "doc_rank", doc)
    d = best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return d.select(query, doc, "place", F.round(-F.col("b.s"), 8).alias("score"), F.col("b.chunk_id").alias("best_chunk"))


def review_pool(rankings: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """Ranked rows (keys, method, rank, chunk_id, kind, text) up to rank k by candidate: the distinct chunks as one text, in the
    order of methods and ranks."""
    d = rankings.where(F.col("rank") <= k)
    first = d.groupBy(*keys, "chunk_id", "text").agg(F.min(F.struct("method", "rank", "kind")).alias("m"))
    line = F.concat(F.lit("["), F.coalesce(F.nullif("m.kind", F.lit("")), F.lit("chunk")), F.lit("] "), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("m.method").alias("a"), F.col("m.rank").alias("b"), F.col("chunk_id").alias("c"), line.alias("t"))))
    return first.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda x: x["t"]), " || ").alias("evidence"))


def longest(df: DataFrame, length: Column, seq: list[str], k: int) -> DataFrame:
    """The k longest rows, of equal ones the first, with their place."""
    d = df.withColumn("_n", length).orderBy(F.desc("_n"), *seq).limit(k)
    return d.withColumn("place", F.row_number().over(Window.orderBy(F.desc("_n"), *seq))).drop("_n")  # k rows


def ranked_definitions(rows: DataFrame, keys: list[str], score: Column, restricted: Column) -> DataFrame:
    """Distinct (keys) with a definition, the first of each by seq, by score, unrestricted ones first, then source and text."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    d = rows.where(F.coalesce("definition", F.lit("")) != "").withColumn("score", score).withColumn("restricted", restricted).withColumn("_n", first).where("_n = 1").drop("_n")
    return numbered(d, [F.desc("score"), "restricted", "source", "definition", "seq"], "rank")


def discovery_order(candidates: DataFrame, known_ids: DataFrame, known_names: DataFrame, warnings: list[str]) -> DataFrame:
    """Candidates (id, name, score) with existing (id or name known), warnings (terms in the name) and place: new ones, ones
    without a warning, high scores first, then by name and id."""
    d = candidates.join(known_ids.select("id").distinct().withColumn("_i", F.lit(True)), "id", "left").join(known_names.select("name").distinct().withColumn("_n", F.lit(True)), "name", "left")
    found = F.filter(F.array(*map(F.lit, warnings)), lambda t: F.contains(F.col("name"), t))
    d = d.withColumn("existing", F.coalesce("_i", "_n", F.lit(False))).withColumn("warnings", found).drop("_i", "_n")
    return numbered(d, ["existing", F.size("warnings") > 0, F.desc("score"), "name", "id"])


def in_match_order(terms: Column) -> Column:
    """Terms of an array from long to short, equal lengths by text."""
    return F.transform(F.array_sort(F.transform(terms, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: x["t"])


def full_text(fields: list[tuple[str, Column]]) -> Column:
    """Sections (position, title, content) in fixed order: blank ones are left out and the others numbered from 1."""
    all_ = F.array(*(F.struct(F.lit(t).alias("title"), F.trim(F.coalesce(c.cast("string"), F.lit(""))).alias("content")) for t, c in fields))
    return F.transform(F.filter(all_, lambda s: s["content"] != ""), lambda s, i: F.struct((i + 1).alias("position"), s["title"].alias("title"), s["content"].alias("content")))


def search_items(hits: DataFrame, store: DataFrame, favourites: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Hits with their record, one a hit, and whether it is a favourite; a record that names another id than its key's fails."""
    ok = F.when(F.col("own_id") == F.col(doc), F.lit(True)).otherwise(F.raise_error(F.lit("a record names another id")).cast("boolean"))
    d = hits.join(store, doc).where(ok).drop("own_id")
    return d.join(favourites.select(doc).distinct().withColumn("favourite", F.lit(True)), doc, "left").withColumn("favourite", F.coalesce("favourite", F.lit(False)))


def equal_sequences(counts: DataFrame, models: list[str], order: str) -> DataFrame:
    """(left, right, identical) of pairs of models (columns of counts): whether all rows agree. One row a pair, no sequence is gathered."""
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    one = counts.agg(*(F.min(F.col(a).eqNullSafe(F.col(b)).cast("int")).alias(f"{a}__{b}") for a, b in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), (F.coalesce(f"{a}__{b}", F.lit(1)) == 1).alias("identical")) for a, b in pairs))).alias("x")).select("x.*")
