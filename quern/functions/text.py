"""Column functions on text. Character classes are spelt out: Java's \\s and Python's differ."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

BLANK = r"[ \t]"
#: White space in Unicode's sense.
WIDE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"

_sub = F.regexp_replace


def trimmed(text: Column) -> Column:
    """Trimmed of blanks and line feeds."""
    return _sub(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def nullable(text: Column) -> Column:
    """Trimmed of blanks and line feeds; empty as null."""
    return F.nullif(trimmed(text), F.lit(""))


def lines(text: Column) -> Column:
    """Images and tags dropped, blanks as one space, trimmed around line feeds, at most one empty line."""
    t = _sub(text, r"\r\n?", "\n")
    t = _sub(_sub(t, r"(?is)<img\b[^>]*>.*?</img>", ""), r"(?i)</?img\b[^>]*>", "")
    t = _sub(_sub(t, r"[ \t]+", " "), r" ?\n ?", "\n")
    return trimmed(_sub(t, r"\n{3,}", "\n\n"))


def lines_normalised(text: Column) -> Column:
    """lines(); empty as null."""
    return F.nullif(lines(text), F.lit(""))


#: Texts that a vectorised function has as Python strings at a time; the rest of a batch stays in Arrow's buffers.
PART = 128


def by_parts(texts: pa.Array, f: Callable[[str | None], object], kind: pa.DataType) -> pa.Array:
    """`f` of each text of a batch, a part of it at a time, so that long texts and what is made of them never stand twice in memory."""
    parts = [pa.array([f(t) for t in texts.slice(at, PART).to_pylist()], kind) for at in range(0, len(texts), PART)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(StringType())
def _unescaped(text: pa.Array) -> pa.Array:
    return by_parts(text, lambda t: t if t is None else html.unescape(t), pa.string())


def entities(text: Column) -> Column:
    """All character references of markup. One use of `text`, which often is a long expression: a task sends all its texts in any case."""
    return _unescaped(text)


def closed_references(markup: Column) -> Column:
    """Markup in which the commonest references count where they end in a semicolon alone; entities() reads &amp without one too, as browsers do."""
    return _sub(markup, "&(?!(?:lt|gt|quot|#39|nbsp|copy|middot|amp);)", "&amp;")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is used; no Python function may stand in `use`."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chunk_normalised(text: Column) -> Column:
    r"""Markup as text for chunks: written-out \r\n, \n and \t, breaks and paragraph ends as line feeds, other tags as spaces, entities.

    Blanks become one space and go around line feeds; at most one empty line stays. A no-break space is kept; null is empty.
    """
    t = F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\r\\n"), F.lit("\n")), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit(" "))
    t = _sub(_sub(t, r"\r\n?", "\n"), r"(?i)<br[ \t-\r]*/?>|</p[ \t-\r]*>", "\n")
    t = _sub(entities(_sub(t, r"<[^>]+>", " ")), r"[ \t\f\x0b]+", " ")
    return _sub(_sub(_sub(t, r" *\n *", "\n"), r"\n{3,}", "\n\n"), rf"^{WIDE}+|{WIDE}+$", "")


_BREAKS, _TAGS = r"<(?:[bB][rR][ \t-\r]*/?|/[pP][ \t-\r]*)>", r"<[^>]+>"


def _read(markup: pa.Array) -> pa.Array:
    """Breaks and paragraph ends as line feeds, other tags as spaces, references read; null is empty."""
    t = pc.replace_substring_regex(pc.replace_substring_regex(pc.fill_null(markup, ""), _BREAKS, "\n"), _TAGS, " ")
    plain = pc.replace_substring(t, "&nbsp;", "\u00a0")  # by far the commonest; where no other is left, this is all that unescape() does
    more = pc.match_substring_regex(plain, "&")
    return pc.replace_with_mask(plain, more, pa.array(map(html.unescape, t.filter(more).to_pylist()), pa.string())) if pc.any(more).as_py() else plain


def _body(markup: pa.Array) -> pa.Array:
    t = pc.replace_substring_regex(pc.replace_substring(_read(markup), "\u00a0", " "), r"[ \t\r\f\x0b]+", " ")
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(t, r"\n{3,}", "\n\n"))


def _line(markup: pa.Array) -> pa.Array:
    t = _read(pc.replace_substring(markup, "<br/>", "\x1c"))  # the commonest break, as white space that no other break can have
    return pc.binary_join(pc.utf8_split_whitespace(pc.utf8_trim_whitespace(t)), " ")


def _in_parts(texts: pa.Array, f: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """by_parts() for a function of arrays of texts."""
    return pa.concat_arrays([f(texts.slice(at, PART)) for at in range(0, len(texts), PART)] or [texts])


@F.arrow_udf(StringType())
def _bodies(markup: pa.Array) -> pa.Array:
    return _in_parts(markup, _body)


def body_normalised(text: Column) -> Column:
    """Markup as text for reading: as chunk_normalised(), but nothing written out is meant, a no-break space is a space, and spaces stay around line feeds."""
    return _bodies(text)


@F.arrow_udf(StructType([StructField("line", StringType()), StructField("beside", StringType())]))
def _lines(markup: pa.Array, beside: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([_in_parts(markup, _line), beside.cast(pa.string())], ["line", "beside"])


def body_line(text: Column, beside: Column) -> Column:
    """Struct (line, beside): one_line(body_normalised(text)) in the same pass of Python, as white space ends as one space in any case.

    `beside` comes back as it is: what has the text's source is made together with the text then, and not once more after Python.
    """
    return _lines(text, beside)


def one_line(text: Column) -> Column:
    return _sub(_sub(text, rf"{WIDE}+", " "), r"^ | $", "")


def clean_lines(text: Column) -> Column:
    """Breaks as line feeds, each line on one space, blank lines dropped."""
    parts = F.transform(F.split(_sub(text, r"(?i)<br */?>", "\n"), "\n"), lambda x: _sub(_sub(x, r"[ \t\r]+", " "), r"^ | $", ""))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n")


def paragraphs(text: Column) -> Column:
    """Paragraphs, parted by empty lines, with one empty line between; blanks are one space and go around line feeds, which stay."""
    lines = lambda x: _sub(_sub(_sub(x, r"[ \t\f\x0b]+", " "), r" *\n *", "\n"), rf"^{WIDE}+|{WIDE}+$", "")
    parts = F.transform(F.split(_sub(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), r"\n{2,}"), lines)
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-cased runs of letters A-Z, Hangul syllables and digits of `least` characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9가-힣]+"), F.lit(0)), lambda x: F.length(x) >= least)


def found_terms(text: Column, terms: list[str]) -> Column:
    """The terms that the text contains, in the list's order."""
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def excerpt(text: Column, terms: list[str], most: int) -> Column:
    """`most` characters from somewhat before the first place of any term, with ... where cut; from the start if there is none."""
    places = F.filter(F.transform(F.array(*map(F.lit, terms)), lambda t: F.instr(text, t)), lambda i: i > 0)
    at = F.greatest(F.coalesce(F.array_min(places), F.lit(1)) - 1 - min(70, most // 3), F.lit(0))
    return F.concat(F.when(at > 0, "...").otherwise(""), F.substring(text, at + 1, F.lit(most)), F.when(at + most < F.length(text), "...").otherwise(""))


def in_context(text: Column, start: Column, end: Column, radius: int = 45) -> Column:
    """The match in brackets with `radius` characters on both sides, ... where cut."""
    low, high = F.greatest(start - radius, F.lit(0)), F.least(end + radius, F.length(text))
    return F.concat(F.when(low > 0, "...").otherwise(""), F.substring(text, low + 1, start - low), F.lit("["), F.substring(text, start + 1, end - start), F.lit("]"), F.substring(text, end + 1, high - end), F.when(high < F.length(text), "...").otherwise(""))


def truncated(text: Column, most: int) -> Column:
    """(text, cut): the first `most` characters without trailing blanks, and whether there were more."""
    return F.struct(F.when(F.length(text) > most, F.rtrim(F.substring(text, 1, most))).otherwise(text).alias("text"), (F.length(text) > most).alias("cut"))


def preview(first: Column, second: Column, most: int = 180) -> Column:
    """The first text that is not blank; beyond `most` characters cut to three less and `...`."""
    t = F.coalesce(nullable(first), nullable(second))
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 3)), F.lit("..."))).otherwise(t)


def unbalanced(text: Column) -> Column:
    """Whether round or square brackets do not open as often as they close."""
    n = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return (n("(") != n(")")) | (n("[") != n("]"))


def masked_parameter(url: Column, name: str) -> Column:
    """The value of one query parameter of a URL as ***."""
    return _sub(url, rf"([?&]{name}=)[^&#]*", "$1***")


def redacted(text: Column, secret: Column) -> Column:
    return F.when(secret != "", F.replace(text, secret, F.lit("[REDACTED]"))).otherwise(text)


def slug(text: Column, most: int = 60) -> Column:
    return F.substring(_sub(_sub(F.lower(text), "[^a-z0-9가-힣]+", "-"), "^-+|-+$", ""), 1, most)


def date_of_digits(text: Column) -> Column:
    """Eight digits as YYYY-MM-DD if year, month and day are in range (a 31st of any month is), else the fixed words for none."""
    d = _sub(text, "[^0-9]", "")
    year, month, day = (F.substring(d, a, n).try_cast("int") for a, n in ((1, 4), (5, 2), (7, 2)))
    ok = (F.length(d) == 8) & (year >= 1800) & month.between(1, 12) & day.between(1, 31)
    return F.when(ok, F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))).otherwise(F.lit("날짜 없음"))


def year_of(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "^([0-9]{4})", 1), F.lit("")).cast("int")


#: What years of the older national calendar are ahead by.
AHEAD = 2333


def case_number(text: Column) -> Column:
    """A case number without white space; of a plain one whose year (3000 to 9999) is of the older calendar, in the common one."""
    t = _sub(text, rf"{WIDE}+", "")
    year = F.regexp_extract(t, "^([3-9][0-9]{3})[가-힣]+[0-9]+$", 1)
    return F.when(year != "", F.concat((year.try_cast("int") - AHEAD).cast("string"), F.substring(t, 5, 1_000_000))).otherwise(t)


def case_parts(text: Column) -> Column:
    """(year, code, serial) of a plain case number: two to four digits, Hangul, digits; short years below 30 are of the 2000s.

    Of any other text the year is null and the rest is empty.
    """
    p = "^([0-9]{2,4})([가-힣]+)([0-9]+)$"
    y = F.regexp_extract(text, p, 1)
    n = F.nullif(y, F.lit("")).cast("int")
    year = F.when(F.length(y) == 4, n).when(n < 30, 2000 + n).otherwise(1900 + n)
    return F.struct(year.alias("year"), F.regexp_extract(text, p, 2).alias("code"), F.regexp_extract(text, p, 3).alias("serial"))


def case_list(text: Column) -> Column:
    """The parts of a comma list of case numbers: a bare serial gets region, year and code of the last full number before it;
    what is neither stays as it is."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: _sub(x, rf"^{WIDE}+|{WIDE}+$", "")), lambda x: x != "")
    empty = F.struct(F.lit("").alias("lead"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc, x):
        own = F.regexp_extract(x, "^([가-힣]*[0-9]{2,4}[가-힣]+)[0-9]", 1)
        bare = x.rlike("^[0-9]+([(].*)?$") & (acc["lead"] != "")
        full = F.when((own == "") & bare, F.concat(acc["lead"], x)).otherwise(x)
        return F.struct(F.when(own != "", own).otherwise(acc["lead"]).alias("lead"), F.array_append(acc["out"], full).alias("out"))

    return F.aggregate(parts, empty, step, lambda a: a["out"])


def article_label(number: Column, branch: Column) -> Column:
    return F.concat(F.lit("제"), number.cast("string"), F.lit("조"), F.when(branch.isNotNull() & (branch.cast("string") != ""), F.concat(F.lit("의"), branch.cast("string"))).otherwise(""))


def stable_id(code: Column, *parts: Column) -> Column:
    """The code if there is one, else 16 hex digits of the SHA-256 of the parts, bar-joined."""
    return F.coalesce(nullable(code), F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16)))


@F.pandas_udf(StringType())
def match_text(text: pd.Series) -> pd.Series:
    """Tags as spaces, entities, compatibility forms composed, lower case, white space as one space."""
    cleaned = text.str.replace(r"<[^>]+>", " ", regex=True)
    return cleaned.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", html.unescape(t)).lower().split()), na_action="ignore")


def match_key(text: Column) -> Column:
    """match_text without white space: the key that spellings of a term share."""
    return _sub(match_text(text), rf"{WIDE}+", "")


def headword_key(text: Column) -> Column:
    """The key without hyphens, circumflexes and middle dots too."""
    return _sub(match_key(text), "[-^·ㆍ]+", "")


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def composed(text: Column) -> Column:
    """Compatibility forms composed; plain ASCII, which has none, stays in the JVM."""
    return F.when(text.rlike(r"^[\x00-\x7f]*$"), text).otherwise(_composed(text))


def term_key(text: Column) -> Column:
    """Compatibility forms composed, lower case, no white space; null as empty."""
    return _sub(F.lower(composed(F.coalesce(text, F.lit("")))), rf"{WIDE}+", "")


def ends_as_statute(name: Column, endings: list[str]) -> Column:
    """Whether a name of three characters or more ends as statutes' names do."""
    return (F.length(name) >= 3) & name.rlike("(" + "|".join(endings) + ")$")


def numbered(items: Column) -> Column:
    """Structs (category, definition) as numbered lines."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". ["), F.trim(x["category"]), F.lit("] "), F.trim(x["definition"]))), "\n")


def judgment_type(text: Column) -> Column:
    """Spellings of a judgment's type as one: forms composed, one space, spaces about colons, the full bench set apart."""
    t = _sub(_sub(composed(F.coalesce(text, F.lit(""))), rf"{WIDE}+", " "), " ?: ?", " : ")
    return F.trim(_sub(t, "전원합의체 ?(판결|결정)", "전원합의체 $1"))


def case_name(text: Column) -> Column:
    """A case's name without double quotes, on one line."""
    return one_line(_sub(body_normalised(F.coalesce(text, F.lit(""))), '["“”]', ""))


def without_heading(text: Column, heading: Column) -> Column:
    """An article's text without its heading, if it begins with it; null if nothing is left."""
    return nullable(F.when(F.startswith(text, heading), F.substring(text, F.length(heading) + 1, F.length(text))).otherwise(text))


#: The levels of headings, from the widest: each is named by its last syllable after a number.
HEADING_LEVELS = ("편", "장", "절", "관")


def heading_label(text: Column) -> Column:
    """The shortest beginning that names a heading ("제1장"), else null."""
    return F.nullif(F.regexp_extract(text, "^(제.+?(?:" + "|".join(HEADING_LEVELS) + "))", 1), F.lit(""))


def heading_level(text: Column) -> Column:
    """part, chapter, section or subsection: the first whose syllable follows a beginning 제 and something more on its line; else unknown."""
    out = F
    for name, syllable in zip(("part", "chapter", "section", "subsection"), HEADING_LEVELS, strict=True):
        out = out.when(text.rlike(f"^제[^\n]+{syllable}"), name)
    return out.otherwise("unknown")


@F.pandas_udf(BooleanType())
def _evidence_in(evidence: pd.Series, corpus: pd.Series) -> pd.Series:
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKC", t or "") if c.isalnum())
    return pd.Series([len(e := plain(a)) >= 2 and e in plain(b) for a, b in zip(evidence, corpus, strict=True)], dtype="bool")


def evidence_in(evidence: Column, corpus: Column) -> Column:
    """Whether the evidence, letters and digits alone, two or more of them, stands in the corpus, letters and digits alone."""
    return _evidence_in(evidence, corpus)


#: A reason of little substance: up to so many characters, and one of these said.
LOW_SUBSTANCE = (
    (1200, "(상고장|항소장).*(각하|보정|인지대|송달료|기간 내|기간내)"),
    (1200, "(판결문|판결).*명백한 오류|판결선고일.*경정|직권으로 주문과 같이 결정"),
    (1500, "청구의 표시|별지 청구원인|무변론 판결|자백간주"),
    (1200, "(제1심|원심).*이유.*(그대로 )?인용|민사소송법 제420조"),
)


def low_substance(text: Column, rules: tuple = LOW_SUBSTANCE) -> Column:
    """Whether any rule (most characters, pattern) holds of a text."""
    out = F.lit(False)
    for most, pattern in rules:
        out = out | ((F.length(text) <= most) & text.rlike(pattern))
    return out
