"""Decisions on records: cascades of rules, checks of verdicts from outside, and how later decisions change earlier ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.validate import all_failing, choice, require_unique


def first_reason(rules: list[tuple[Column, str, Column]], otherwise: tuple[str, Column]) -> Column:
    """(decision, reason) of the first rule (condition, decision, reason) that holds; nulls do not hold."""
    pair = lambda d, r: F.struct(F.lit(d).alias("decision"), r.alias("reason"))
    return reduce(lambda w, r: w.when(r[0], pair(r[1], r[2])), rules, F).otherwise(pair(*otherwise))


def joined_reasons(reasons: list[tuple[Column, Column]], separator: str = "; ") -> Column:
    """The reasons whose condition holds, joined; empty if none does."""
    return F.array_join(F.filter(F.array(*(F.when(c, r) for c, r in reasons)), lambda x: x.isNotNull()), separator)


def core_fields(issue: Column, summary: Column, policy: str = "issue_or_summary") -> Column:
    """Whether a record has its core fields: both under issue_and_summary, else one."""
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return has(issue) & has(summary) if policy == "issue_and_summary" else has(issue) | has(summary)


def in_length_range(text: Column, below: int | None = None, at_least: int | None = None) -> Column:
    """Whether a text's length is below one bound (exclusive) and at another or more; a bound of None is none."""
    n, ok = F.length(F.coalesce(text, F.lit(""))), F.lit(True)
    ok = ok if below is None else ok & (n < below)
    return ok if at_least is None else ok & (n >= at_least)


def rule_precision(df: DataFrame, judged: Column, excluded: Column, right: Column) -> DataFrame:
    """labelled, evaluated, correct, precision (4 places; null of none): of judged rows those a rule excludes, and rightly so."""
    both = judged & excluded
    n, good = F.count_if(both), F.count_if(both & right)
    return df.agg(F.count_if(judged).alias("labelled"), n.alias("evaluated"), good.alias("correct"), F.round(good / F.nullif(n, F.lit(0)), 4).alias("precision"))


def decision_faults(target: DataFrame, decisions: DataFrame, on: list[str]) -> DataFrame:
    """Of targets (on, allowed: array of grades) and decisions (on, grade, independent, assessment): faults of each, in order.

    missing, extra, twice; not_allowed; where all of 0 to 3 are allowed not_independent (the grade is the independent one and
    nothing is assessed), else wrong_assessment (supported if the independent grade is allowed, else unsupported).
    """
    n = decisions.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("grade", "independent", "assessment")))
    d = target.join(n, on, "full_outer")
    free = F.size("allowed") == 4
    expected = F.when(F.array_contains("allowed", F.col("independent")), "supported").otherwise("unsupported")
    there = F.col("allowed").isNotNull() & F.col("n").isNotNull()
    rules = [
        ("missing", F.col("n").isNull()),
        ("extra", F.col("allowed").isNull()),
        ("twice", F.col("n") > 1),
        ("not_allowed", there & ~F.array_contains("allowed", F.col("grade"))),
        ("not_independent", there & free & ((F.col("grade") != F.col("independent")) | (F.col("assessment") != "not_applicable"))),
        ("wrong_assessment", there & ~free & (F.col("assessment") != expected)),
    ]
    return d.withColumn("faults", all_failing(rules)).select(*on, "faults")


def combined(sources: list[tuple[str, DataFrame]], on: list[str]) -> DataFrame:
    """Decisions of all sources with the source's name; a key that is decided twice fails the job."""
    tagged = [d.withColumn("source", F.lit(name)) for name, d in sources]
    return require_unique(reduce(DataFrame.unionByName, tagged), on)


def changed_positives(before: DataFrame, after: DataFrame, on: list[str], positive: int = 2) -> DataFrame:
    """rechecked, lowered (positive before, not after), kept and remaining positives of grades before and after a recheck."""
    d = before.select(*on, F.col("grade").alias("a")).join(after.select(*on, F.col("grade").alias("b")), on, "left")
    now = F.coalesce("b", "a")
    up, still = F.col("a") >= positive, now >= positive
    return d.agg(F.count("b").alias("rechecked"), F.count_if(up & ~still).alias("lowered"), F.count_if(up & still).alias("kept"), F.count_if(still).alias("remaining"))


def policies(gold: DataFrame, adjudicated: DataFrame, on: list[str]) -> DataFrame:
    """(on, policy, grade): the majority's grades, and the same with independent ones where a row was adjudicated."""
    d = gold.join(adjudicated.select(*on, F.col("independent")), on, "left")
    pair = F.array(F.struct(F.lit("majority").alias("policy"), F.col("grade").alias("g")), F.struct(F.lit("independent").alias("policy"), F.coalesce("independent", "grade").alias("g")))
    return d.select(*on, F.explode(pair).alias("p")).select(*on, "p.policy", F.col("p.g").alias("grade"))


def resolved(draft: DataFrame, resolutions: DataFrame, on: list[str]) -> DataFrame:
    """Adds final and changed; a resolution of an unknown or repeated key, or of a grade outside 0 to 3, fails the job."""
    r = require_unique(resolutions.select(*on, F.col("grade").alias("_new")), on)
    d = draft.withColumn("_there", F.lit(True)).join(r, on, "full_outer")
    ok = F.col("_there").isNotNull() & (F.col("_new").isNull() | F.col("_new").between(0, 3))
    d = d.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("a resolution of no draft row, or no grade")).cast("boolean")))
    final = F.coalesce("_new", "grade")
    return d.withColumn("final", final).withColumn("changed", final != F.col("grade")).drop("_new", "_there")


def with_additions(base: DataFrame, changes: DataFrame, additions: DataFrame, on: list[str]) -> DataFrame:
    """Labels with changes (from, to) and additions, and what became of each: kept, changed, added.

    A change that does not start from its `from`, and an addition that is there already, fail the job.
    """
    d = base.join(changes.select(*on, "from", "to"), on, "left")
    good = F.col("from").isNull() | F.col("from").eqNullSafe(F.col("grade"))
    grade = F.when(good, F.coalesce("to", "grade")).otherwise(F.raise_error(F.lit("a change does not start from the label it names")).cast("int"))
    status = F.when(F.col("to").isNull(), "kept").otherwise("changed")
    now = d.select(*on, grade.alias("grade"), status.alias("status"))
    return require_unique(now.unionByName(additions.select(*on, "grade", F.lit("added").alias("status"))), on)


def priority_sources(sources: list[tuple[str, DataFrame]], key: str, verdict: str) -> DataFrame:
    """(key, source, place): keys of rows with a verdict, of the first source that has them, in the order first met.

    Sources have columns key, verdict and seq (the row's place in its source).
    """
    rows = [d.where((F.col("verdict") == verdict) & (F.coalesce(key, F.lit("")) != "")).select(key, F.lit(k).alias("_s"), F.lit(name).alias("source"), "seq") for k, (name, d) in enumerate(sources)]
    best = reduce(DataFrame.unionByName, rows).groupBy(key).agg(F.min(F.struct("_s", "seq", "source")).alias("m"))
    return best.select(key, "m.source", F.struct("m._s", "m.seq").alias("order"))


def basic_verdict(raw: DataFrame) -> DataFrame:
    """Columns related and confidence as allowed words; reviewed by rule where it is missing, always if uncertain or low; the reason
    of exclusion defaults to the reason where unrelated. fault says that the reason, which is required, is missing."""
    d = raw.withColumn("related", choice(F.col("related"), ["unrelated", "related", "uncertain"], "uncertain")).withColumn("confidence", choice(F.col("confidence"), ["high", "medium", "low"], "low"))
    unsure = (F.col("related") == "uncertain") | (F.col("confidence") == "low")
    blank = F.trim(F.coalesce("reason", F.lit(""))) == ""
    return d.withColumn("needs_review", F.when(unsure, True).otherwise(F.coalesce("needs_review", unsure))).withColumn("exclusion", F.when(F.col("related") == "unrelated", F.coalesce(F.nullif("exclusion", F.lit("")), "reason")).otherwise(F.nullif("exclusion", F.lit("")))).withColumn("fault", F.when(blank, "missing_reason"))


def explanation_fault(evidence_a: Column, in_a: Column, evidence_b: Column, in_b: Column, reason: Column, must: str, most_evidence: int = 300, most: int = 500, least: int = 20) -> Column:
    """The first fault of an explanation (evidence of two sides, each found in its source or not, and a reason), else null."""
    rules = [("first_too_long", F.length(evidence_a) > most_evidence), ("second_too_long", F.length(evidence_b) > most_evidence), ("first_not_found", ~in_a), ("second_not_found", ~in_b), ("empty", F.coalesce(F.trim(reason), F.lit("")) == ""), ("too_long", F.length(reason) > most), ("incomplete", (F.length(reason) < least) | ~F.contains(reason, F.lit(must)))]
    return reduce(lambda w, r: w.when(r[1], r[0]), rules, F).otherwise(F.lit(None).cast("string"))


def structured_fault(raw: Column) -> Column:
    """The first fault of a comparison in JSON: its fields, a list of similarities with one or more, points without blanks."""
    point = "struct<user_point:string,case_point:string,explanation:string>"
    got = F.from_json(raw, f"similarities array<{point}>, differences array<{point}>, comparison_text string, notice string")
    keys = F.array_sort(F.json_object_keys(raw))
    blank = lambda t: F.trim(F.coalesce(t, F.lit(""))) == ""
    bad = lambda items: F.exists(items, lambda x: blank(x["user_point"]) | blank(x["case_point"]) | blank(x["explanation"]))
    fields = F.array(*map(F.lit, ["comparison_text", "differences", "notice", "similarities"]))
    rules = [("fields", keys.isNull() | (keys != fields)), ("not_a_list", got["similarities"].isNull() | got["differences"].isNull()), ("no_similarity", F.size(got["similarities"]) == 0), ("blank_point", bad(got["similarities"]) | bad(got["differences"])), ("blank_text", blank(got["comparison_text"]))]
    return reduce(lambda w, r: w.when(r[1], r[0]), rules, F).otherwise(F.lit(None).cast("string"))


def mismatches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(field, expected, actual) where two tables of (field, value) differ, missing fields too."""
    d = expected.withColumnRenamed("value", "expected").join(actual.withColumnRenamed("value", "actual"), "field", "full_outer")
    return d.where(~F.col("expected").eqNullSafe(F.col("actual"))).select("field", "expected", "actual")


def source_comparison(source: DataFrame, other: DataFrame, same_date: Column) -> DataFrame:
    """missing and extra rows of two multisets, and the verdict: matched, version_mismatch where the dates differ, else error."""
    missing = source.exceptAll(other).agg(F.count(F.lit(1)).alias("missing"))
    extra = other.exceptAll(source).agg(F.count(F.lit(1)).alias("extra"))
    d = missing.join(F.broadcast(extra))  # one row each
    equal = (F.col("missing") == 0) & (F.col("extra") == 0)
    return d.withColumn("comparison", F.when(equal, "matched").when(~same_date, "version_mismatch").otherwise("error"))
