"""Readers and writers of record files. Schemas are declared, never inferred."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_directory(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """One record a file, with source_path and, as order, numeric file names first, then the name."""
    d = spark.read.schema(schema).json(path, multiLine=True).withColumn("source_path", F.input_file_name())
    stem = F.regexp_extract("source_path", r"([^/]+)\.[^./]*$", 1)
    number = stem.try_cast("long")
    order = (number.isNull(), number, stem)
    return d.orderBy(*order).limit(limit) if limit is not None else d.withColumn("file_order", F.struct(number.isNull().alias("named"), number.alias("number"), stem.alias("stem")))


def json_lines(spark: SparkSession, path: str, schema: str, key: str | None = None, strict: bool = True) -> DataFrame:
    """Records of a lines file. Strict: blank lines are skipped, others that are no record fail the job, as a repeated key does.
    Lenient: lines that are no record are dropped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema).alias("r"), F.try_parse_json("value").isNotNull().alias("ok"))
    if not strict:
        return parsed.where("ok and r is not null").select("r.*")
    good = F.when(F.col("ok"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not a record: "), F.left("value", F.lit(80)))).cast("boolean"))
    d = parsed.where(good).select("r.*")
    if key:
        from quern.operators.validate import require_unique

        d = require_unique(d, [key])
    return d


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of text columns; a byte-order mark is no part of the first name."""
    d = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return d.toDF(*(c.lstrip("﻿") for c in d.columns))


def columnar_rows(arrays: dict[str, Column]) -> Column:
    """Rows of parallel arrays: to the longest, shorter ones filled with ''; explode the result."""
    filled = {k: F.coalesce(a, F.array()) for k, a in arrays.items()}
    n = F.greatest(*(F.size(a) for a in filled.values())) if len(filled) > 1 else F.size(next(iter(filled.values())))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(places, lambda i: F.struct(*(F.coalesce(F.get(a, i), F.lit("")).alias(k) for k, a in filled.items())))


def xml_nodes(spark: SparkSession, path: str, row_tag: str, schema: str | T.StructType) -> DataFrame:
    """Elements of a tag from XML files; a namespace prefix is no part of a name."""
    return spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).schema(schema).load(path)


def flattened(tree: DataFrame, levels: list[str], root: str, text: str = "text") -> DataFrame:
    """Nested arrays of structs as rows (root, kind, node_id, parent_node_id, ord, text): one level below the other.

    Ids are the path of kinds and places, law:7:article:0001:paragraph:0002. Every struct has `text` and, but for the last
    level, an array named after the next level.
    """
    at = tree.select(F.col(root).cast("string").alias("root"), F.concat(F.lit("law:"), F.col(root).cast("string")).alias("parent"), F.col(levels[0]).alias("nodes"))
    out = None
    for k, kind in enumerate(levels):
        rows = at.select("root", "parent", F.posexplode("nodes").alias("place", "n"))
        own = F.concat_ws(":", "parent", F.lit(kind), F.lpad((F.col("place") + 1).cast("string"), 4, "0"))
        flat = rows.select("root", F.lit(kind).alias("kind"), own.alias("node_id"), F.col("parent").alias("parent_node_id"), (F.col("place") + 1).alias("ord"), F.col(f"n.{text}").alias("text"))
        out = flat if out is None else out.union(flat)
        if k + 1 < len(levels):
            at = rows.select("root", own.alias("parent"), F.col(f"n.{levels[k + 1]}").alias("nodes"))
    return out


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in reading order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def write_json_lines(df: DataFrame, path: str) -> None:
    """Records as lines, nulls kept; the job's commit makes them visible at once."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_review_table(df: DataFrame, path: str, joiner: str = " | ") -> None:
    """A CSV table; arrays as joined text."""
    cols = [F.array_join(F.col(f.name).cast("array<string>"), joiner).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema.fields]
    df.select(*cols).write.mode("overwrite").csv(path, header=True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_missing(spark: SparkSession, df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the table at `path` does not have yet; returns how many. A table that has keys which `df` does
    not know is refused. One writer at a time: two at once may both append a key."""
    before, new = 0, df
    if exists(spark, path):
        have = spark.read.schema(df.schema).parquet(path).select(key)
        if have.join(df.select(key), key, "left_anti").limit(1).count():
            raise ValueError("the table has keys that are not in the input")
        before, new = have.count(), df.join(have, key, "left_anti").select(df.columns)
    new.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path).count() - before


_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that executors share (spark.checkpoint.dir; a folder of its own where all run in this process),
    removed when the driver ends."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = _OWN.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="quern-files-"))
    path = f"{top.rstrip('/')}/quern-files-{uuid.uuid4().hex[:12]}-{name}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


# ---- what a collector leaves ----


def collected_pages(pages: DataFrame, by: list[str]) -> DataFrame:
    """Cached pages (by, page, total, display, items: array) that a paged search reads: up to the last one that its total needs,
    and none from an empty page on. No page is fetched: pages that are not there end the search."""
    w = Window.partitionBy(*by).orderBy("page")
    d = pages.withColumn("_gap", (F.col("page") != F.row_number().over(w)) | (F.size("items") == 0))
    stop = F.max(F.col("_gap").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    needed = F.coalesce(F.lag(F.col("page") * F.col("display") >= F.col("total")).over(w), F.lit(False))
    over = F.max(needed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_stop", stop)
    return d.withColumn("_over", over).where("_stop = 0 and _over = 0").drop("_gap", "_stop", "_over")


def exact_record(wanted: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Adds status to wanted records: collected where exactly one found record agrees in all keys, else not_found or ambiguous."""
    n = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"))
    d = wanted.join(n, keys, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return d.withColumn("status", F.when(F.col("matches") == 0, "not_found").when(F.col("matches") > 1, "ambiguous").otherwise("collected"))


def failure_log(attempts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of attempts (keys, order, error) the last state of each key (success, failed), its tries, and whether it is to be tried again."""
    g = attempts.groupBy(*keys).agg(F.count(F.lit(1)).alias("tries"), F.max(F.struct(order, "error")).alias("last"))
    state = F.when(F.col("last.error").isNull(), "success").otherwise("failed")
    return g.select(*keys, "tries", state.alias("state"), F.col("last.error").alias("error"), F.col("last.error").isNotNull().alias("retry"))


def manifest(chunks: DataFrame, length: str, by: str, seq: str, k: int = 24) -> dict:
    """Counts by kind, a length summary and the ids of the k longest chunks: a bounded record for the folder of a job's output."""
    n = chunks.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(by).collect()
    s = chunks.agg(F.count(F.lit(1)), F.min(length), F.max(length), F.sum(length)).first()
    top = chunks.orderBy(F.desc(length), seq).select(seq, length).limit(k).collect()
    return {"counts": {r[0]: r[1] for r in n}, "length": {"count": s[0], "min": s[1], "max": s[2], "sum": s[3]}, "longest": [[r[0], r[1]] for r in top]}


def markdown_table(df: DataFrame, most: int = 10_000) -> str:
    """A report's table of a few rows, in their order, numbers to the right; more than `most` rows are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    right = [isinstance(f.dataType, T.NumericType) for f in df.schema.fields]
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---:" if r else "---" for r in right], *([cell(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(raw: bytes, header: list[str], sheet: int = 1) -> list[dict[str, str]]:
    """Rows of a workbook's sheet below the first row that has all names of `header`; blank rows are skipped, cells are text."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(t.text or "" for t in i.iter(f"{SHEET}t")) for i in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        rows = []
        for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{SHEET}row"):
            cells = {}
            for c in row:
                text = "".join(t.text or "" for t in c.iter() if t.tag in (f"{SHEET}v", f"{SHEET}t"))
                cells["".join(filter(str.isalpha, c.get("r")))] = shared[int(text)] if c.get("t") == "s" else text
            rows.append(cells)
    at = next((i for i, r in enumerate(rows) if set(header) <= {v.strip() for v in r.values()}), None)
    if at is None:
        raise ValueError(f"no row has the names {header}")
    names = {column: name.strip() for column, name in rows[at].items() if name.strip()}
    return [{name: r.get(column, "") for column, name in names.items()} for r in rows[at + 1 :] if any(v.strip() for v in r.values())]


def workbooks(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """Rows of all workbooks of a path, a workbook a task: the columns of `header` as text."""

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                rows = sheet_rows(raw, header)
                yield pa.RecordBatch.from_arrays([pa.array([r[h] for r in rows], pa.string()) for h in header], names=header)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join(f"`{h}` string" for h in header))
