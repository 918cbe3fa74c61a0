"""Queries of files: tables are written as a collector would leave them and read back."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from quern.operators.encoding import encoded
from quern.plans.catalog import query
from quern.sources import files as S
from quern.streaming.store import Store, fill
from quern.tables import load


@query("SELECT doc_id, lang, text FROM documents", "SNK-1 SRC-2")
def json_lines(spark, sf_dir):
    """Documents as lines of records and back; a key that is there twice, or a line that is no record, fails the job."""
    path = S.scratch(spark, "lines")
    S.write_json_lines(load(spark, sf_dir, "documents").select("doc_id", "lang", "text"), path)
    return S.json_lines(spark, path, "doc_id long, lang string, text string", key="doc_id")


@query("SELECT event_id, event_type FROM events WHERE event_id % 7 <> 0", "SRC-3")
def lenient_lines(spark, sf_dir):
    """Lines of which every seventh is cut off in the middle: these are dropped."""
    path = S.scratch(spark, "cut-lines")
    line = F.to_json(F.struct("event_id", "event_type"))
    load(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(path)
    return S.json_lines(spark, path, "event_id long, event_type string", strict=False)


@query("SELECT n_nationkey, n_name, CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS place FROM nation", "SRC-1")
def json_directory(spark, sf_dir):
    """A folder of records, one a file, in the order of the numbers in their names."""
    from pyspark.sql import Window

    path = S.scratch(spark, "records")
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_nationkey").alias("k"))
    n.repartition(25, "k").write.partitionBy("k").json(path)
    d = S.json_directory(spark, f"{path}/*", "n_nationkey int, n_name string")
    return d.select("n_nationkey", "n_name", F.row_number().over(Window.orderBy("n_nationkey")).cast("long").alias("place"))


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderpriority, 'a | ' || o_orderstatus AS tags FROM orders", "SNK-2 SRC-4")
def review_table(spark, sf_dir):
    """A review table in CSV, arrays as joined text, and back: all columns are text."""
    path = S.scratch(spark, "review")
    S.write_review_table(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.array(F.lit("a"), "o_orderstatus").alias("tags")), path)
    return S.csv_table(spark, path)


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier", "SRC-6")
def xml_records(spark, sf_dir):
    """Records as elements of XML files, one a nation, with a prefix to their names, and back."""
    path = S.scratch(spark, "xml")
    fields = [x for c in ("s_suppkey", "s_name", "s_nationkey") for x in (F.lit(f"<n:{c}>"), F.col(c).cast("string"), F.lit(f"</n:{c}>"))]
    rows = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.concat(F.lit("<n:supplier>"), *fields, F.lit("</n:supplier>")).alias("x"))
    file = F.concat(F.lit('<n:all xmlns:n="urn:n">'), F.array_join(F.collect_list("x"), "\n"), F.lit("</n:all>"))
    rows.groupBy("k").agg(file.alias("value")).write.partitionBy("k").text(path)
    return S.xml_nodes(spark, f"{path}/*", "supplier", "s_suppkey long, s_name string, s_nationkey int")


@query("""
WITH g AS (SELECT user_id, list(event_id ORDER BY event_id) AS ids, list(event_type ORDER BY event_id) FILTER (event_type <> 'view') AS types FROM events GROUP BY 1),
p AS (SELECT user_id, ids, types, unnest(range(1, len(ids) + 1)) AS i FROM g)
SELECT user_id, ids[i]::VARCHAR AS id, coalesce(types[i], '') AS type FROM p
""", "SRC-13")
def columnar_records(spark, sf_dir):
    """Parallel arrays as rows; the shorter one is filled with empty texts."""
    rows = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    g = load(spark, sf_dir, "events").groupBy("user_id").agg(rows.alias("r"))
    ids, types = F.transform("r", lambda x: x["event_id"].cast("string")), F.transform(F.filter("r", lambda x: x["event_type"] != "view"), lambda x: x["event_type"])
    return g.select("user_id", F.inline(S.columnar_rows({"id": ids, "type": types})))


@query("SELECT vec_id, label FROM embeddings", "SNK-3 STM-4")
def resumed_upsert(spark, sf_dir):
    """A store that is filled in two runs, of which the second adds what the first has not."""
    path, e = S.scratch(spark, "store"), load(spark, sf_dir, "embeddings").select("vec_id", "label")
    S.append_missing(spark, e.where("label < 5"), path, "vec_id")
    S.append_missing(spark, e, path, "vec_id")
    return spark.read.schema(e.schema).parquet(path)


@query("SELECT n_nationkey::VARCHAR AS query_id, n_name AS query_candidate FROM nation", "SRC-5")
def workbook(spark, sf_dir):
    """A sheet with a title and a blank row above its header, and back."""
    rows = [("some queries",), (), ("query_id", "query_candidate")] + [(r[0], r[1]) for r in load(spark, sf_dir, "nation").select("n_nationkey", "n_name").limit(10_000).collect()]
    cells = "".join(f"<row>{''.join(f'<c r="{c}{i}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>' for c, v in zip('AB', r, strict=False))}</row>" for i, r in enumerate(rows, 1))
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{S.SHEET[1:-1]}"><sheetData>{cells}</sheetData></worksheet>')
    path = S.scratch(spark, "workbook") + ".xlsx"
    sc = spark.sparkContext
    to = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(sc._jsc.hadoopConfiguration()).create(to)
    out.write(raw.getvalue())
    out.close()
    return S.workbooks(spark, path, ["query_id", "query_candidate"])


@query("""
WITH p AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 + 1 AS page FROM events), g AS (SELECT user_id, page, count(*) AS items FROM p GROUP BY ALL)
SELECT user_id, page, items FROM g WHERE page <= CASE WHEN user_id % 3 = 0 THEN 2 ELSE ceil((SELECT count(*) FROM events e WHERE e.user_id = g.user_id) / 10.0) END
""", "SRC-7 SRC-8")
def page_scan(spark, sf_dir):
    """Cached pages of a search for each user, of which some end with an empty page before their total."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    e = load(spark, sf_dir, "events").withColumn("page", F.floor((F.row_number().over(w.orderBy("event_id")) - 1) / 10) + 1).withColumn("total", F.count(F.lit(1)).over(w))
    g = e.groupBy("user_id", "page", "total").agg(F.collect_list("event_id").alias("items")).withColumn("display", F.lit(10))
    g = g.withColumn("items", F.when((F.col("user_id") % 3 == 0) & (F.col("page") == 3), F.expr("cast(array() as array<bigint>)")).otherwise(F.col("items")))
    return S.collected_pages(g, ["user_id"]).select("user_id", "page", F.size("items").cast("long").alias("items"))


@query("""
WITH w AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), f AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL)
SELECT l_orderkey, l_linenumber, coalesce(n, 0) AS matches, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'collected' END AS status FROM w LEFT JOIN f USING (l_orderkey, l_linenumber)
""", "SRC-9 SRC-10")
def exact_records(spark, sf_dir):
    """Records that are collected where exactly one found record agrees in number and name."""
    l = load(spark, sf_dir, "lineitem")  # noqa: E741
    keys = ["l_orderkey", "l_linenumber"]
    return S.exact_record(l.select(*keys).distinct(), l.where("l_returnflag <> 'R'"), keys)


@query("""
SELECT user_id, count(*) AS tries, CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'failed' ELSE 'success' END AS state, CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'error' END AS error, arg_max(event_type, event_id) = 'error' AS retry FROM events GROUP BY 1
""", "SNK-6")
def failure_log(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", F.col("event_type")).alias("error"))
    return S.failure_log(e, ["user_id"], "event_id")


@query("""
WITH l AS (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 24)
SELECT 'count ' || source AS field, count(*)::VARCHAR AS value FROM documents GROUP BY source UNION ALL SELECT 'length max', max(n_chars)::VARCHAR FROM documents UNION ALL SELECT 'length sum', sum(n_chars)::VARCHAR FROM documents
UNION ALL SELECT 'longest', string_agg(doc_id::VARCHAR, ',' ORDER BY n_chars DESC, doc_id) FROM l
""", "SNK-5")
def manifest(spark, sf_dir):
    m = S.manifest(load(spark, sf_dir, "documents"), "n_chars", "source", "doc_id")
    rows = [(f"count {k}", str(v)) for k, v in m["counts"].items()] + [("length max", str(m["length"]["max"])), ("length sum", str(m["length"]["sum"])), ("longest", ",".join(str(i) for i, _ in m["longest"]))]
    return spark.createDataFrame(rows, "field string, value string")


@query("""
WITH r AS (SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1)
SELECT '| event_type | n | mean |' || chr(10) || '| --- | ---: | ---: |' || chr(10) || string_agg('| ' || event_type || ' | ' || n || ' | ' || printf('%.4f', mean) || ' |', chr(10) ORDER BY event_type) AS report FROM r
""", "SNK-7")
def report(spark, sf_dir):
    g = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean")).orderBy("event_type")
    return spark.createDataFrame([(S.markdown_table(g),)], "report string")


class Killed(RuntimeError):
    """A job that dies between a batch's data and its entry in the ledger."""


@query("SELECT event_id, user_id FROM events", "SNK-3 STM-4")
def streamed_upsert(spark, sf_dir):
    """A store that a stream of four files fills; the job dies between data and ledger of the third, and another goes on."""
    from pyspark.errors import StreamingQueryException

    e = load(spark, sf_dir, "events").select("event_id", "user_id")
    source, at, path = S.scratch(spark, "stream"), S.scratch(spark, "progress"), S.scratch(spark, "ledger")
    e.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def die(batch):
        if batch == 2:
            raise Killed("between data and ledger")

    try:
        fill(stream, Store(spark, path, "event_id long, user_id long", "event_id"), at, die)
    except StreamingQueryException as error:
        if "between data and ledger" not in str(error):
            raise
    store = Store(spark, path, "event_id long, user_id long", "event_id")
    fill(stream, store, at)
    return store.read()


@query("""
SELECT doc_id, CASE WHEN length(text) <= 60000 THEN length(text)::DOUBLE END AS chars, CASE WHEN length(text) <= 60000 THEN (length(text) - length(replace(text, 'e', '')))::DOUBLE END AS e, CASE WHEN length(text) > 60000 THEN 'too long' END AS error
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
""", "VEC-4")
def split_encoding(spark, sf_dir):
    """Every document through an encoder that takes 60,000 characters at once: batches are halved, longer texts are reported."""

    def make():
        def encode(texts):
            if sum(map(len, texts)) > 60_000:
                raise MemoryError("too long")
            return [[float(len(t)), float(t.count("e"))] for t in texts]

        return encode

    d = encoded(load(spark, sf_dir, "documents"), "doc_id", "text", make, 2)
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return d.select("doc_id", at(0).alias("chars"), at(1).alias("e"), "error")
