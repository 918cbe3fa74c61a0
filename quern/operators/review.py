"""Review workflows: who is to look at what, and what a text is cut down to for it."""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quern.functions.text import WIDE


def needs_review(score: Column, confidence: Column, seed: Column) -> Column:
    """Scored 1 or more, not sure, or unlike a seed label."""
    return (F.coalesce(score, F.lit(0)) >= 1) | (F.coalesce(confidence, F.lit("")) != "high") | (seed.isNotNull() & ~seed.eqNullSafe(score))


def in_list_order(df: DataFrame, ids: list, key: str) -> DataFrame:
    """The rows of a list of ids, with its place; an id that is missing or there twice fails the job."""
    wanted = df.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], df.select(F.col(key)).schema.add("place", IntegerType()))
    d = wanted.join(df.withColumn("_there", F.lit(True)), key, "left")
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    good = F.when(F.col("_there") & (n == 1), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not there once: "), F.col(key).cast("string"))).cast("boolean"))
    return d.withColumn("_ok", good).where("_ok").drop("_ok", "_there")


def without_keys(df: DataFrame, fields: list[str], excluded: DataFrame, key: str = "key") -> DataFrame:
    """Drops excluded keys (of any number) from arrays of structs with `key`; empty fields become null, rows without any go."""
    others = [c for c in df.columns if c not in fields]
    rows = df.withColumn("_row", F.struct(*others))
    items = None
    for c in fields:
        one = rows.select("_row", F.lit(c).alias("_field"), F.posexplode(c).alias("_at", "_item")).withColumn("_key", F.col("_item")[key])
        items = one if items is None else items.unionByName(one)
    left = items.join(excluded.select(F.col("key").alias("_key")).distinct(), "_key", "left_anti")
    arrays = [F.transform(F.array_sort(F.collect_list(F.when(F.col("_field") == c, F.struct("_at", "_item")))), lambda x: x["_item"]).alias(c) for c in fields]
    kept = left.groupBy("_row").agg(*arrays)
    return kept.select(*(F.when(F.size(c) > 0, F.col(c)).alias(c) if c in fields else F.col(f"_row.{c}") for c in df.columns))


def first_of_each(df: DataFrame, group: str, order: list[str], limit: int) -> DataFrame:
    """The first row of each group, up to a number of groups in the order of their first rows."""
    first = df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_n = 1").drop("_n")
    return first.orderBy(*order).limit(limit)


def evidence(df: DataFrame, by: list[str], core: list[str], terms: list[str], text: str, number: str, most: int) -> DataFrame:
    """Up to `most` rows of each group that have a term: more core terms first, then more terms, then the lower number."""
    found = lambda ts: F.filter(F.array(*map(F.lit, ts)), lambda t: F.contains(F.col(text), t))
    d = df.withColumn("core", F.size(found(core))).withColumn("matched", found(terms)).where(F.size("matched") > 0)
    return d.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("core"), F.desc(F.size("matched")), number))).where(F.col("place") <= most)


def distinct_first(df: DataFrame, fields: list[str], by: list[str], order: list[str]) -> DataFrame:
    """Of rows that are alike as text in some fields the first of each group."""
    keys = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by, *keys).orderBy(*order))).where("_n = 1").drop("_n")


def case_key(number: Column, case_id: Column) -> Column:
    """What makes cases alike: the number without white space, in lower case; the id where there is none."""
    key = F.lower(F.regexp_replace(F.coalesce(number, F.lit("")), WIDE, ""))
    return F.when(key != "", key).otherwise(F.concat(F.lit("precedent:"), case_id.cast("string")))


def islands(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of windows, those that overlap or touch as one: a new one begins where no window before it reaches."""
    order = np.argsort(begins, kind="stable")
    begins, reach = begins[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.r_[True, begins[1:] > reach[:-1]])
    return begins[first], reach[np.r_[first[1:], len(begins)] - 1]


EXCERPT = "text string, windows int, chars int"


def excerpts(headings: list[str], keywords: list[str], most: int, head: tuple[int, int], tail: tuple[int, int], about_heading: tuple[int, int], about_keyword: tuple[int, int], keyword_windows: int, title: str = "이유 발췌"):
    """A function of a text column: beginning, end and windows about headings and the first keywords, merged, up to `most`.

    Texts of up to `most` characters stay whole (0 windows); null is empty. head and tail are (characters, part of most: a
    third is 3), the less counts. Keywords are looked for one after another, in any case, and the first windows count. Parts are
    trimmed, blank ones left out, and the one that passes `most` is cut there. Each is preceded by [title number: begin~end];
    `chars` counts the whole excerpt.
    """
    edge = min(head[0], most // head[1]), min(tail[0], most // tail[1])
    wanted = [(re.compile(p, re.I), *about_heading, None) for p in headings], [(re.compile(p, re.I), *about_keyword, keyword_windows) for p in keywords]

    def places(text: str) -> np.ndarray:
        """A row (begin, end) a window, not yet kept within the text."""
        rows = [(0, edge[0]), (len(text) - edge[1], len(text))]
        for kind in wanted:
            hits = ((m.start() - before, m.end() + after) for p, before, after, _ in kind for m in p.finditer(text))
            rows.extend(islice(hits, kind[0][3] if kind else 0))
        return np.clip(np.array(rows, np.int64), 0, len(text))

    def excerpt(text: str) -> tuple[str, int, int]:
        if len(text) <= most:
            return text, 0, len(text)
        begins, ends = islands(*places(text).T)
        shown, spare = [], most
        for a, z, part in ((a, z, text[a:z].strip()) for a, z in zip(begins.tolist(), ends.tolist(), strict=True)):
            fits = part if len(part) <= spare else part[:spare].rstrip()
            if fits or (part and spare):
                shown.append((a, z if fits is part else a + len(fits), fits))
                spare -= len(fits)
        out = "\n\n...\n\n".join(f"[{title} {k}: {a}~{z}]\n{part}" for k, (a, z, part) in enumerate(shown, 1))
        return out, len(shown), len(out)

    @F.pandas_udf(EXCERPT)
    def run(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([excerpt(t or "") for t in text], columns=["text", "windows", "chars"])

    return run


def score_by_rules(text: Column, title: Column, weights: list[tuple[str, list[str], int, int]]) -> Column:
    """Sum over rules (where, terms, weight, most hits) of weight times the terms found, up to most."""
    total = F.lit(0)
    for where, terms, weight, most in weights:
        source = title if where == "title" else text
        total = total + F.least(F.size(_hits(source, terms)), F.lit(most)) * weight
    return total


def _hits(source: Column, terms: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(source, t))
