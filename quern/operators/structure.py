"""Trees and cuts: heading paths, chunks, sections, packing, merged intervals, sessions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import by_parts


def heading_path(df: DataFrame, by: list[str], order: str, level: Column, label: Column, depth: int) -> DataFrame:
    """Adds path: the labels of the last heading of each level that no heading above it has ended since."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    at = [F.max(F.when(level == k, F.struct(F.col(order).alias("o"), label.alias("l")))).over(w) for k in range(depth)]
    d = df.select("*", *(a.alias(f"_{k}") for k, a in enumerate(at)))
    live = []
    for k in range(depth):
        ok = F.col(f"_{k}").isNotNull()
        for up in range(k):
            ok = ok & (F.col(f"_{up}").isNull() | (F.col(f"_{up}.o") < F.col(f"_{k}.o")))
        live.append(F.when(ok, F.col(f"_{k}.l")))
    return d.select(*df.columns, F.filter(F.array(*live), lambda x: x.isNotNull()).alias("path"))


def chunks(parents: DataFrame, children: DataFrame, key: str, order: str, head: Column, line: Column) -> DataFrame:
    """(key, chunk_type, children, retrieval_text): a header and the children's lines in order; the header alone where there is
    no child. A parent's children, which are bounded, meet in one row."""
    body = children.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    d = parents.select(key, head.alias("head")).join(body, key, "left")
    return d.select(key, F.when(F.col("n").isNull(), "fallback").otherwise("article").alias("chunk_type"), F.coalesce("n", F.lit(0)).alias("children"), F.concat_ws("\n", "head", "body").alias("retrieval_text"))


def merge_intervals(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Intervals of each group that overlap or touch as one, with their number."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("_new", (before.isNull() | (F.col(start) > before)).cast("int"))
    d = d.withColumn("_g", F.sum("_new").over(w))
    return d.groupBy(*by, "_g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("parts")).drop("_g")


# ---- cutting long texts; order-dependent, so plain Python within a vectorised function ----

#: Chunk size and overlap, from which share of a window on a sentence's end is a good place to cut, and below how many
#: characters a unit is glued to the next one.
SIZE, OVERLAP, CUT_FROM, SMALL = 800, 120, 0.6, 120
#: White space after the last syllable or sign of a sentence; what a short line says that introduces the next;
#: a line of judges' names; how far from the end such lines are looked for, and which share of the text must remain.
SENTENCE = r"(?<=[.다요임음함됨)])\s+"
INTRO, INTRO_CHARS = "(상고이유|재항고이유|항소이유|원심판결 이유|기초사실|판단|본다|대하여)", 80
SIGNATURE = r"(?m)^\s*(?:대법원판사|대법관|판사|재판장|주심)\s*[가-힣A-Za-z·ㆍ\s,()]+$"
SIGNATURE_REACH, MUST_REMAIN = 1200, 0.5

_SENTENCE, _INTRO, _SIGNATURE = re.compile(SENTENCE), re.compile(INTRO), re.compile(SIGNATURE)


def split_long(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Windows of up to `size` characters, cut after a sentence if one ends late enough, each begun `overlap` before the last's end.

    Sentences' ends are looked for in the window alone, as white space after a sentence's last syllable.
    """
    out, start = [], 0
    while len(text) - start > size:
        late = [m.end() for m in _SENTENCE.finditer(text[start : start + size]) if m.end() >= size * CUT_FROM]
        end = start + (late[-1] if late else size)
        out.append(text[start:end].strip())
        start = max(end - overlap, start + 1)
    if start < len(text):
        out.append(text[start:].strip() if out else text)
    return [part for part in out if part]


def units(text: str, size: int = SIZE) -> list[str]:
    """What chunks are packed from: lines, introductions with the line they introduce, small ones with the next, long ones cut."""
    lines, whole = [x.strip() for x in text.split("\n") if x.strip()], []
    at = 0
    while at < len(lines):
        introduces = len(lines[at]) <= INTRO_CHARS and _INTRO.search(lines[at])
        if introduces and at + 1 == len(lines) and whole:
            whole[-1] += "\n" + lines[at]
        else:
            whole.append("\n".join(lines[at : at + 2]) if introduces else lines[at])
        at += 2 if introduces else 1
    out, at = [], 0
    while at < len(whole):
        step = 2 if len(whole[at]) < SMALL else 1
        out += split_long("\n".join(whole[at : at + step]), size, 0)
        at += step
    return out


def overlap_of(chunk: str, overlap: int) -> str:
    """What the next chunk begins with: the chunk's end, from a line's begin on unless that is in the last characters."""
    if not 0 < overlap < len(chunk):
        return ""
    tail = chunk[-overlap:].strip()
    head, line_feed, rest = tail.partition("\n")
    return rest.strip() if line_feed and len(head) < len(tail) - 20 else tail


def pack(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Units packed greedily into chunks; a chunk begins with the end of the one before where both fit."""
    out: list[str] = []
    now = ""
    for unit in units(text, size):
        if now and len(now) + 1 + len(unit) > size:
            out.append(now)
            now = overlap_of(now, overlap)
            if len(now) + 1 + len(unit) > size:
                now = ""
        now = f"{now}\n{unit}".strip()
    return [*out, now] if now else out


def without_signatures(text: str) -> tuple[str, bool]:
    """The text without the judges' names at its end, and whether there were any; the whole text if too little would remain."""
    found = _SIGNATURE.search(text[max(0, len(text) - SIGNATURE_REACH) :])
    kept = text[: max(0, len(text) - SIGNATURE_REACH) + found.start()].rstrip() if found else text
    return (text, False) if not found or len(kept) < len(text) * MUST_REMAIN else (kept, True)


@F.arrow_udf(T.ArrayType(T.StringType()))
def packed(text: pa.Array) -> pa.Array:
    return by_parts(text, lambda t: pack(t or ""), pa.list_(pa.string()))


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("cut", T.BooleanType())]))
def signatures_cut(text: pa.Array) -> pa.Array:
    return by_parts(text, lambda t: dict(zip(("text", "cut"), without_signatures(t or ""), strict=True)), pa.struct([("text", pa.string()), ("cut", pa.bool_())]))


def case_chunks(cases: DataFrame, key: str, split: list[tuple[str, str, str]], whole: list[tuple[str, str, str]]) -> DataFrame:
    """(key, chunk_id, section, place, chunk) of cases: sections to split, and sections that are one chunk each.

    Sections are (column, name in ids, title); empty ones give nothing. Ids are precedent:key:name:number in four digits.
    """

    def numbered(chunks: Column, name: str, title: str) -> Column:
        return F.transform(chunks, lambda x, i: F.struct(F.lit(name).alias("name"), F.lit(title).alias("section"), (i + 1).alias("place"), x.alias("chunk")))

    parts = [numbered(packed(c), n, t) for c, n, t in split]
    parts += [numbered(F.filter(F.array(F.coalesce(F.col(c), F.lit(""))), lambda x: x != ""), n, t) for c, n, t in whole]
    d = cases.select(key, F.explode(F.concat(*parts)).alias("x"))
    return d.select(key, F.format_string("precedent:%s:%s:%04d", F.col(key).cast("string"), "x.name", "x.place").alias("chunk_id"), "x.section", "x.place", "x.chunk")


def split_by_groups(children: DataFrame, key: str, order: str, line: Column, groups: DataFrame) -> DataFrame:
    """(key, part, parts, chunk): children dealt to configured groups (key, order, part); both must have the same children."""
    d = children.withColumn("_line", line).join(groups.select(key, order, "part"), [key, order], "full_outer")
    ok = F.col("part").isNotNull() & F.col("_line").isNotNull()
    d = d.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("the groups are not a partition of the children")).cast("boolean")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_line").alias("t")))), lambda x: x["t"]), "\n")
    g = d.groupBy(key, "part").agg(body.alias("chunk"))
    return g.withColumn("parts", F.count(F.lit(1)).over(Window.partitionBy(key))).select(key, "part", "parts", "chunk")


HEADER = r"【([^】\n]{1,40})】"


def sections(text: Column) -> Column:
    """(title, body) for each 【title】 of a text, titles without blanks; what stands before the first is left out."""
    titles = F.transform(F.regexp_extract_all(text, F.lit(HEADER), F.lit(1)), lambda t: F.regexp_replace(t, "[ \t]+", ""))
    bodies = F.slice(F.split(text, HEADER, -1), 2, 1_000_000)
    return F.zip_with(titles, bodies, lambda a, b: F.struct(a.alias("title"), F.trim(b).alias("body")))


def section_until(text: Column, title: str, stops: list[str] | None = None) -> Column:
    """The body of the first section of a title, on to the next section of a stop title; to the end without stops."""
    all_ = sections(text)
    from_ = F.array_position(F.transform(all_, lambda s: s["title"]), title)
    rest = F.slice(all_, F.greatest(from_, F.lit(1)).cast("int"), 1_000_000)
    start = F.struct(F.lit(False).alias("stop"), F.lit("").alias("out"), F.lit(0).alias("i"))

    def step(a, s):
        stop = a["stop"] | ((a["i"] > 0) & s["title"].isin(stops or []))
        add = F.when(a["i"] == 0, s["body"]).otherwise(F.concat(a["out"], F.lit("\n"), s["title"], F.lit("\n"), s["body"]))
        return F.struct(stop.alias("stop"), F.when(stop, a["out"]).otherwise(add).alias("out"), (a["i"] + 1).alias("i"))

    return F.when(from_ > 0, F.aggregate(rest, start, step, lambda a: a["out"])).otherwise("")
