"""Spans of texts against tokens: an interval join, checks of alignment, greedy choice, and what became of each key's matches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.matching import apart
from quern.operators.order import accumulated, written

#: Tags that a term may end in, by their beginning or whole.
NOMINAL_BEGIN, NOMINAL = "NN", ("NR", "NP", "SL", "SH", "SN", "XR", "XPN", "XSN")


def nominal(tag: Column) -> Column:
    """Whether a term may end in a morpheme of this tag."""
    return tag.startswith(NOMINAL_BEGIN) | tag.isin(*NOMINAL)


def overlapping(spans: DataFrame, tokens: DataFrame, width: int = 64) -> DataFrame:
    """Pairs of spans (id, start, end, ..) and tokens (id, start, end, ..) that share a place, the tokens' columns as t_start, t_end, ..

    Both are put into the bins of `width` places that they touch, so that a long text is as many groups as it has bins; a
    pair is taken in the bin where the later of the two begins, once.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.greatest(F.col(b), F.col(a) + 1) - 1) / width)))
    t = tokens.select("id", *(F.col(c).alias(f"t_{c}") for c in tokens.columns if c != "id"))
    s = spans.withColumn("_bin", bins("start", "end"))
    t = t.withColumn("_bin", bins("t_start", "t_end"))
    met = s.join(t, ["id", "_bin"]).where("start < t_end and t_start < end")
    return met.where(F.floor(F.greatest("start", "t_start") / width) == F.col("_bin")).drop("_bin")


def aligned(spans: DataFrame, tokens: DataFrame, good: Callable[[Column], Column] = nominal) -> DataFrame:
    """Adds reason to spans (span, id, start, end, ..): no_morpheme, not_token_aligned, non_nominal_morpheme, or null for a valid one.

    Of the tokens (id, start, end, tag) that a span shares a place with, the first must begin where it begins and the last end
    where it ends, in a good tag; first and last are by start, then end. `span` tells spans apart.
    """
    at = F.struct("t_start", "t_end", "t_tag")
    ends = overlapping(spans.select("span", "id", "start", "end"), tokens.select("id", "start", "end", "tag")).groupBy("span").agg(F.min(at).alias("a"), F.max(at).alias("z"))
    d = spans.join(ends, "span", "left")
    fits = (F.col("a.t_start") == F.col("start")) & (F.col("z.t_end") == F.col("end"))
    reason = F.when(F.col("a").isNull(), "no_morpheme").when(~fits, "not_token_aligned").when(~good(F.col("z.t_tag")), "non_nominal_morpheme")
    return d.withColumn("reason", reason).select(*spans.columns, "reason")


def chosen(spans: DataFrame) -> DataFrame:
    """Adds kept to spans (span, id, start, end, key): the longest that do not overlap, then the first, then the least key.

    A sweep over all begins and ends, by running sums, cuts texts into islands of spans that touch; a choice in one island
    changes nothing in another, so each is chosen by itself, and a text of many spans is many groups.
    """
    d = written(spans.select("span", "id", "start", "end", "key"), "spans")
    begins = d.select("id", F.col("start").alias("at"), F.lit(1).alias("step"), "span")
    events = begins.union(d.select("id", F.col("end").alias("at"), F.lit(-1).alias("step"), "span"))
    depth = accumulated(events, ["id", "at", "step", "span"], _open=("sum", F.col("step"))).where("step = 1")
    islands = accumulated(depth.withColumn("_new", (F.col("_open") == 1).cast("int")), ["id", "at", "span"], _island=("sum", F.col("_new"))).select("span", "_island")

    def choose(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keep = set(apart([(r["start"], r["end"], (r["key"], r["span"])) for r in rows]))
        return pa.table({"span": table.column("span"), "kept": pa.array([(r["start"], r["end"], (r["key"], r["span"])) in keep for r in rows])})

    kind = dict(spans.dtypes)["span"]
    picked = d.join(islands, "span").groupBy("_island").applyInArrow(choose, f"span {kind}, kept boolean")
    return spans.join(picked, "span")


def term_validation(spans: DataFrame, tokens: DataFrame, most_examples: int = 5, good: Callable[[Column], Column] = nominal) -> DataFrame:
    """A row a key of spans (span, id, start, end, key): texts, occurrences, reject counts by reason, the first examples, status.

    Matches that tokens do not bear out are rejected first; of valid ones that overlap the choice of chosen() counts, the others
    are `overlapped`, which is no rejection of the key. status: excluded without any valid occurrence, partial with rejections, else valid.
    """
    judged = written(aligned(spans, tokens, good), "judged")
    valid = chosen(judged.where("reason is null").drop("reason"))
    counts = valid.groupBy("key").agg(F.countDistinct(F.when(F.col("kept"), F.col("id"))).alias("texts"), F.count_if("kept").alias("occurrences"), F.count_if(~F.col("kept")).alias("overlapped"))
    bad = judged.where("reason is not null")
    reasons = ("no_morpheme", "not_token_aligned", "non_nominal_morpheme")
    rejects = bad.groupBy("key").agg(*(F.count_if(F.col("reason") == r).alias(r) for r in reasons))
    # the first few of each block of spans, then of those, so that no key's rejects come to one task
    example = F.struct("id", "start", "reason")
    few = lambda c: F.slice(F.array_sort(c), 1, most_examples)
    part = bad.groupBy("key", F.floor(F.col("id") / 64).alias("_part")).agg(few(F.collect_list(example)).alias("e"))
    part = part.groupBy("key", F.pmod("_part", F.lit(256)).alias("_part")).agg(few(F.flatten(F.collect_list("e"))).alias("e"))
    examples = part.groupBy("key").agg(few(F.flatten(F.collect_list("e"))).alias("examples"))
    d = spans.select("key").distinct().join(counts, "key", "left").join(rejects, "key", "left").na.fill(0).join(examples, "key", "left")
    lost = sum((F.col(r) for r in reasons[1:]), F.col(reasons[0]))
    return d.withColumn("status", F.when(F.col("occurrences") == 0, "excluded").when(lost > 0, "partial").otherwise("valid"))
