"""Corpus pipeline: from `documents` to token ids, in five stages that are each written before the next one reads them.

Every stage takes documents with null ids and texts, rows that repeat, empty tables and further columns; a null text counts as
empty. All but the last return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._common import drop_table, work_table
from quern.llm.bpe import bpe_round_trip
from quern.llm.decontaminate import decontaminate
from quern.llm.exact_dedup import drop_copies
from quern.llm.jaccard_join import drop_similar
from quern.llm.quality import fit_quality, keep_good

VOCABULARY = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, does not reject; all of them where it has nothing to learn from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs, fit_quality(docs, labels, F.lit(True)))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id; rows that repeat it stay, rows without an id stay."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more over five-word shingles the smallest doc_id; empty texts and rows without an id stay."""
    return drop_similar(docs, k=5, num=80, den=100)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item leaks into, judged by their text alone."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them; no ids for an empty text."""
    got = bpe_round_trip(docs, public_tokenizers.path(VOCABULARY))
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", clean_of_benchmark),
    ("BPE encoding and decoding", token_ids),
]

#: SQL has no word for the classifier, the edit distances and the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work_table(spark, docs, f"stage-{k}")
            if k:
                drop_table(spark, before)
    return docs
