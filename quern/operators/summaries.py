"""Checks of generated summaries: payloads are JSON text as a model gave it; what is no JSON is an empty payload."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.validate import all_failing

# The opening and the endings that are not wanted, field names, and lengths in characters.
OPENING = "이 판례는"
ENDINGS = ("입니다", "했습니다", "합니다", "됩니다", "있습니다", "없습니다", "였습니다", "하였습니다")
EASY_ENDINGS = ("입니다", "합니다", "했습니다")
ID_FIELDS = ("판례일련번호", "precedent_id")
SUMMARY_FIELD = "생성요약"
LEAST, RECOMMENDED, MOST = 150, 230, 300
EASY_LEAST, EASY_MOST = 80, 700


def _field(parsed: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(parsed, f"$['{name}']", kind)


def _with_length(name: str, text: Column) -> Column:
    return F.concat(F.lit(name + ":"), F.length(text).cast("string"))


def summary_check(payload: Column, expected_id: Column, case_number: Column, court: Column, date: Column) -> Column:
    """Struct (precedent_id, summary, chars, error, warnings) of a summary's payload.

    The id is the expected one, with a warning where the payload had another. An empty summary is an error and has no warnings.
    Warnings, in this order: id, opening, polite endings, too short, too long, beyond the recommended length, metadata named.
    """
    parsed = F.try_parse_json(payload)
    ids = (_field(parsed, name) for name in ID_FIELDS)
    got = T.body_line(_field(parsed, SUMMARY_FIELD), F.trim(F.coalesce(*(F.when(i != "", i) for i in ids), F.lit(""))))
    text, n = got["line"], F.length(got["line"])
    empty = text == ""
    leaks = {"has_case_number": case_number, "has_court": court, "has_date": date}
    rules = [
        ("id_corrected", got["beside"] != expected_id),
        ("banned_opening", F.startswith(text, F.lit(OPENING))),
        ("polite_style", reduce(or_, (F.contains(text, F.lit(e)) for e in ENDINGS))),
        ("too_short", n < LEAST),
        ("too_long", n > MOST),
        ("over_recommended", n > RECOMMENDED),
        *((name, (x != "") & F.contains(text, x)) for name, x in ((name, T.body_normalised(v)) for name, v in leaks.items())),
    ]
    return F.struct(expected_id.alias("precedent_id"), text.alias("summary"), n.alias("chars"), F.when(empty, "empty").alias("error"), F.when(empty, F.array().cast("array<string>")).otherwise(all_failing(rules)).alias("warnings"))


def easy_summary_check(payload: Column, expected_id: Column) -> Column:
    """Struct (summary, errors, warnings) of an easy summary's payload; its paragraphs stay, and lengths stand behind their names.

    Errors: another id, empty, too long, unwanted opening, polite endings, explained terms that are no list. Too short is a warning.
    """
    fields = T.once(F.try_parse_json(payload), lambda p: F.struct(_field(p, "easy_summary").alias("text"), _field(p, "precedent_id").alias("given"), _field(p, "explained_difficult_terms", "array<variant>").isNull().alias("no_list")))

    def checked(x: Column) -> Column:
        text, n = x["text"], F.length(x["text"])
        errors = [
            F.when(F.coalesce(x["given"], F.lit("")) != x["expected"], "precedent_id_mismatch"),
            F.when(text == "", "empty_easy_summary"),
            F.when(n > EASY_MOST, _with_length("too_long", text)),
            F.when(F.startswith(text, F.lit(OPENING)), "starts_with_this_precedent"),
            F.when(text.rlike("|".join(EASY_ENDINGS)), "formal_polite_style"),
            F.when(x["no_list"], "explained_difficult_terms_not_list"),
        ]
        short = F.when((text != "") & (n < EASY_LEAST), _with_length("review_too_short", text))
        return F.struct(text.alias("summary"), F.array_compact(F.array(*errors)).alias("errors"), F.array_compact(F.array(short)).alias("warnings"))

    values = T.once(fields, lambda f: F.struct(T.paragraphs(f["text"]).alias("text"), f["given"].alias("given"), f["no_list"].alias("no_list"), expected_id.alias("expected")))
    return T.once(values, checked)
