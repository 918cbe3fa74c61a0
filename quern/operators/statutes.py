"""Laws as XML documents: adjacency tables of their nodes, checks of the links, and retrieval chunks of their articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.order import written

#: The elements of a law that are read.
LAW_SCHEMA = (
    "`_법령키` string, `기본정보` struct<`법령ID`: string, `법령명_한글`: string, `시행일자`: string>, `조문` struct<`조문단위`: array<struct<"
    "`_조문키`: string, `조문여부`: string, `조문번호`: string, `조문가지번호`: string, `조문제목`: string, `조문시행일자`: string, `조문내용`: string, "
    "`항`: array<struct<`항번호`: string, `항내용`: string, `호`: array<struct<`호번호`: string, `호내용`: string, "
    "`목`: array<struct<`목번호`: string, `목내용`: string>>>>>>>>>"
)
HEADING, ARTICLE = "전문", "조문"
#: The heading levels from the widest on; a heading of one ends all of the same or a narrower level. Others end nothing and stay.
RANKS = {"part": 0, "chapter": 1, "section": 2, "subsection": 3}


def _must(ok: Column, value: Column, what: str, where: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(where, F.lit("?")))).cast("string"))


def _id(parent: Column, *orders: Column) -> Column:
    return F.concat_ws(":", parent, *(F.lpad(o.cast("string"), 4, "0") for o in orders))


def _some(text: Column) -> Column:
    """Empty as null. A nullif() within a function of an array computes its text twice."""
    return T.once(text, lambda t: F.when(t != "", t))


def parsed_laws(laws: DataFrame, raw: str = "raw") -> DataFrame:
    """law_id, law_name, effective_date, headings and articles of each law, an XML document a row.

    Elements of both kinds stand mixed under one; each kind is numbered by itself. An article's heading_path is the stack of
    headings above it, widest first. What is parsed is written, so that no later use parses it again. A document that is no law, lacks id, name or date, or has a unit of an unknown kind or an article
    without a number fails the job.
    """
    root = F.col(raw).rlike(r"^\s*(?:<\?[^>]*\?>\s*)?(?:<!--[\s\S]*?-->\s*)*<법령[\s>]")
    doc = F.from_xml(F.when(root, F.col(raw)).otherwise(F.raise_error(F.lit("the document is no law")).cast("string")), F.lit(LAW_SCHEMA), {"ignoreSurroundingSpaces": "false"})
    d = laws.select(doc.alias("d")).select("d.`기본정보`", F.coalesce("d.`조문`.`조문단위`", F.expr("array()")).alias("units"))
    field = lambda name: T.nullable(F.col(f"`기본정보`.`{name}`"))
    known = field("법령ID").isNotNull() & field("법령명_한글").isNotNull() & field("시행일자").isNotNull()
    law_id = _must(known, field("법령ID"), "a law without id, name or date", field("법령ID"))
    d = d.select(law_id.alias("law_id"), field("법령명_한글").alias("law_name"), field("시행일자").alias("effective_date"), "units")
    kind = lambda u: _some(T.trimmed(u["조문여부"]))
    known = lambda u, k: F.coalesce((k == HEADING) | ((k == ARTICLE) & _some(T.trimmed(u["조문번호"])).isNotNull()), F.lit(False))
    checked = lambda u: T.once(kind(u), lambda k: _must(known(u, k), k, "a unit of unknown kind or without a number", F.col("law_id")))
    d = d.withColumn("units", F.transform("units", lambda u, i: F.struct(i.alias("pos"), checked(u).alias("kind"), u.alias("u"))))
    law = F.concat(F.lit("law:"), F.col("law_id"))

    def heading(x, i):
        def titled(title):
            rank = lambda level: F.coalesce(F.create_map(*(F.lit(v) for kv in RANKS.items() for v in kv))[level], F.lit(-1))
            return T.once(T.heading_level(title), lambda level: F.struct(x["pos"].alias("pos"), (i + 1).alias("ord"), _id(F.concat(law, F.lit(":heading")), i + 1).alias("node_id"), title.alias("title"), level.alias("level"), T.heading_label(title).alias("label"), rank(level).alias("rank")))

        return T.once(F.coalesce(T.lines(x["u"]["조문내용"]), F.lit("")), titled)

    d = d.withColumn("headings", F.transform(F.filter("units", lambda x: x["kind"] == HEADING), heading))
    ends = lambda h: F.array_min(F.transform(F.filter("headings", lambda g: (g["pos"] > h["pos"]) & (g["rank"] >= 0) & (g["rank"] <= h["rank"])), lambda g: g["pos"]))
    opened = F.transform("headings", lambda h: F.struct(h["pos"].alias("pos"), h["node_id"].alias("node_id"), ends(h).alias("until")))

    def article(opened, x, i):
        u = x["u"]
        label = F.concat(F.lit("제"), T.trimmed(u["조문번호"]), F.lit("조"), F.coalesce(F.concat(F.lit("의"), _some(T.trimmed(u["조문가지번호"]))), F.lit("")))
        own = lambda kind, *orders: _id(F.concat(law, F.lit(f":{kind}")), i + 1, *orders)
        path = F.transform(F.filter(opened, lambda h: (h["pos"] < x["pos"]) & (h["until"].isNull() | (h["until"] > x["pos"]))), lambda h: h["node_id"])
        items = lambda p, s, nodes: F.transform(nodes, lambda n, k: F.struct(own("item", p, s, k + 1).alias("node_id"), (k + 1).alias("ord"), _some(T.trimmed(n["목번호"])).alias("label"), _some(T.lines(n["목내용"])).alias("text")))
        subs = lambda p, nodes: F.transform(nodes, lambda n, k: F.struct(own("subparagraph", p, k + 1).alias("node_id"), (k + 1).alias("ord"), _some(T.trimmed(n["호번호"])).alias("label"), _some(T.lines(n["호내용"])).alias("text"), items(p, k + 1, n["목"]).alias("items")))
        paragraphs = F.transform(u["항"], lambda n, k: F.struct(own("paragraph", k + 1).alias("node_id"), (k + 1).alias("ord"), _some(T.trimmed(n["항번호"])).alias("label"), _some(T.lines(n["항내용"])).alias("text"), subs(k + 1, n["호"]).alias("subparagraphs")))
        image = F.coalesce(u["조문내용"].rlike(r"(?is)<img\b[^>]*>.*?</img>"), F.lit(False))
        return F.struct(own("article").alias("node_id"), (i + 1).alias("ord"), label.alias("label"), _some(T.trimmed(u["조문제목"])).alias("title"), _some(T.lines(u["조문내용"])).alias("text"), image.alias("has_image"), _some(T.trimmed(u["조문시행일자"])).alias("effective_date"), path.alias("heading_path"), paragraphs.alias("paragraphs"))

    articles = T.once(opened, lambda o: F.transform(F.filter("units", lambda x: x["kind"] == ARTICLE), lambda x, i: article(o, x, i)))
    return written(d.select("law_id", "law_name", "effective_date", "headings", articles.alias("articles")), "laws")


def law_nodes(laws: DataFrame) -> DataFrame:
    """Every node of parsed laws as a row: law_id, kind, node_id, parent_node_id, ord, label, level, text, heading_path.

    One explode of one array, so a document is parsed once.
    """
    none = F.lit(None).cast("string")

    def node(kind, n, parent, level=none, path=None):
        text = n["title"] if kind == "heading" else n["text"]
        return F.struct(F.lit(kind).alias("kind"), n["node_id"].alias("node_id"), parent.alias("parent_node_id"), n["ord"].alias("ord"), n["label"].alias("label"), level.alias("level"), text.alias("text"), (F.lit(None).cast("array<string>") if path is None else path).alias("heading_path"))

    law = F.concat(F.lit("law:"), F.col("law_id"))
    sub = lambda p: F.transform(p["subparagraphs"], lambda s: F.concat(F.array(node("subparagraph", s, p["node_id"])), F.coalesce(F.transform(s["items"], lambda t: node("item", t, s["node_id"])), F.expr("array()"))))
    para = lambda a: F.transform(a["paragraphs"], lambda p: F.concat(F.array(node("paragraph", p, a["node_id"])), F.coalesce(F.flatten(sub(p)), F.expr("array()"))))
    articles = F.flatten(F.transform("articles", lambda a: F.concat(F.array(node("article", a, law, path=a["heading_path"])), F.coalesce(F.flatten(para(a)), F.expr("array()")))))
    headings = F.transform("headings", lambda h: node("heading", h, law, h["level"]))
    return laws.select("law_id", F.explode(F.concat(F.coalesce(headings, F.expr("array()")), F.coalesce(articles, F.expr("array()")))).alias("n")).select("law_id", "n.*")


def link_faults(nodes: DataFrame) -> DataFrame:
    """(fault, node_id, other) of nodes: an id that occurs twice, a parent or a heading that is not there. None is what is wanted."""
    ids = nodes.select("node_id")
    twice = ids.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("fault"), "node_id", F.lit(None).cast("string").alias("other"))
    known = ids.union(nodes.select(F.concat(F.lit("law:"), F.col("law_id")))).select(F.col("node_id").alias("other")).distinct()
    parents = nodes.where("parent_node_id is not null").select(F.lit("missing_parent").alias("fault"), "node_id", F.col("parent_node_id").alias("other"))
    headings = nodes.where("kind = 'heading'").select(F.col("node_id").alias("other")).distinct()
    paths = nodes.select(F.lit("missing_heading").alias("fault"), "node_id", F.explode("heading_path").alias("other"))
    return twice.union(parents.join(known, "other", "left_anti").select("fault", "node_id", "other")).union(paths.join(headings, "other", "left_anti").select("fault", "node_id", "other"))


def articles_of(laws: DataFrame) -> DataFrame:
    """A row an article of parsed laws, with its law's name, its headings' titles and the texts of each paragraph in order.

    A heading_path that names no heading of the law fails the job; untitled headings are left out of titles.
    """
    d = laws.select("law_id", "law_name", F.col("effective_date").alias("law_date"), "headings", F.explode("articles").alias("a"))
    title = lambda h: F.get(F.filter("headings", lambda x: x["node_id"] == h), 0)["title"]
    found = F.transform("a.heading_path", lambda h: F.coalesce(title(h), F.raise_error(F.concat(F.lit("no such heading: "), h)).cast("string")))
    texts = lambda p: F.filter(F.concat(F.array(p["text"]), F.coalesce(F.flatten(F.transform(p["subparagraphs"], lambda s: F.concat(F.array(s["text"]), F.coalesce(F.transform(s["items"], lambda t: t["text"]), F.expr("array()"))))), F.expr("array()"))), lambda t: t.isNotNull())
    paragraphs = F.transform("a.paragraphs", lambda p: F.struct(p["node_id"].alias("node_id"), p["ord"].alias("ord"), p["label"].alias("label"), texts(p).alias("texts")))
    return d.select("law_id", "law_name", "a.node_id", "a.label", "a.title", "a.text", "a.has_image", F.coalesce("a.effective_date", "law_date").alias("effective_date"), F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: t != "").alias("headings"), F.coalesce(paragraphs, F.expr("array()")).alias("paragraphs"))


#: What Python's strip() takes off.
_WIDE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def article_chunks(articles: DataFrame, groups: DataFrame | Column) -> DataFrame:
    """The chunks of articles (articles_of()); `groups` (node_id, groups) has those that are to be split, or is a column of the articles, null for the others.

    chunk_type: article, or article_part for each group of paragraphs, the article's own text in part 1 only; then, for parent-child
    retrieval, article_parent with paragraph_child rows, or one article_child of an article whose paragraphs have no text. An article
    without any text has one excluded row. Groups that are not the article's paragraphs, each once, fail the job.
    """
    own, said = F.col("node_id"), F.btrim("title", F.lit(_WIDE))
    d = articles.withColumn("groups", groups) if isinstance(groups, Column) else articles.join(groups, "node_id", "left")
    d = d.withColumn("name", F.when(said != "", F.concat("label", F.lit("("), said, F.lit(")"))).otherwise(F.col("label")))
    body = F.btrim(F.when(F.startswith("text", F.col("name")), F.substring("text", F.length("name") + 1, F.length("text"))).otherwise(F.col("text")), F.lit(_WIDE))
    headed = F.when(F.size("headings") > 0, F.concat(F.lit("구조: "), F.array_join("headings", " > ")))
    placed = F.array_sort(F.transform("paragraphs", lambda p, i: F.struct(p["ord"].alias("ord"), i.alias("i"), p.alias("p"))))
    d = d.select("law_id", "node_id", "label", "groups", F.when(body != "", body).alias("body"), F.concat_ws("\n", F.concat(F.lit("법령: "), "law_name"), headed, F.concat(F.lit("조문: "), "name")).alias("top"), F.transform(placed, lambda x: x["p"]).alias("paragraphs"))

    def shown(body, texts, unit=None):
        return F.rtrim(F.concat_ws("\n", "top", *([] if unit is None else [F.concat(F.lit("검색 단위: "), unit)]), F.lit(""), F.lit("본문:"), body, texts), F.lit(_WIDE))

    def chunk(kind, chunk_id, text, source=own, parent=None, index=None, count=None, orders=None, order=None):
        values = {"chunk_id": (chunk_id, "string"), "source_node_id": (source, "string"), "parent_article_id": (parent, "string"), "chunk_type": (F.lit(kind), "string"), "retrieval_text": (text, "string")}
        values |= {"part_index": (index, "int"), "part_count": (count, "int"), "paragraph_orders": (orders, "array<int>"), "paragraph_order": (order, "int")}
        return F.struct(*((F.lit(None) if v is None else v).cast(t).alias(k) for k, (v, t) in values.items()))

    texts = lambda ps: F.flatten(F.transform(ps, lambda p: p["texts"]))
    wanted = F.forall("groups", lambda g: F.coalesce(F.size(g) > 0, F.lit(False))) & (F.array_sort(F.flatten("groups")) == F.transform("paragraphs", lambda p: p["ord"].cast("int")))
    split = F.when(F.coalesce(wanted, F.lit(False)), F.col("groups")).otherwise(F.raise_error(F.concat(F.lit("groups of "), own, F.lit(" are not its paragraphs, each once"))).cast("array<array<int>>"))
    number = lambda k: F.concat(F.when(k < 10, "0").otherwise(""), k.cast("string"))
    part = lambda g, k: chunk("article_part", F.concat(own, F.lit(":part:"), number(k + 1)), shown(F.when(k == 0, F.col("body")), texts(F.filter("paragraphs", lambda p: F.array_contains(g, p["ord"])))), index=k + 1, count=F.size("groups"), orders=F.array_sort(g))
    unit = lambda p: F.concat(F.col("label"), F.lit(" "), F.when(p["label"] != "", p["label"]).otherwise(F.concat(F.lit("제"), p["ord"].cast("string"), F.lit("항"))))
    child = lambda p: chunk("paragraph_child", p["node_id"], shown(F.col("body"), p["texts"], unit(p)), p["node_id"], own, order=p["ord"])
    full = d.select("*", texts("paragraphs").alias("texts"))
    all_of = shown(F.col("body"), F.col("texts"))
    first = F.when(F.col("groups").isNull(), F.array(chunk("article", own, all_of))).otherwise(F.transform(split, part))
    some = F.concat(F.array(chunk("article_parent", own, all_of)), F.transform(F.filter("paragraphs", lambda p: F.size(p["texts"]) > 0), child))
    alone = F.array(chunk("article_parent", own, all_of), chunk("article_child", F.concat(own, F.lit(":child")), shown(F.col("body"), F.lit(None).cast("string"), F.col("label")), parent=own))
    rest = F.when(F.size("texts") > 0, some).when(F.col("body").isNotNull(), alone).otherwise(F.array(chunk("excluded", None, None)))
    return full.select("law_id", F.explode(F.concat(first, rest)).alias("c")).select("law_id", "c.*")


def chunk_faults(chunks: DataFrame) -> DataFrame:
    """One row of counters of parents and children among chunks, all 0 where they fit together; the chunks are made once.

    Each chunk gives its id, a child the id of its parent too; ids meet, and what is counted is what an id has of each.
    """
    parent, child = F.col("chunk_type") == "article_parent", F.col("chunk_type").isin("paragraph_child", "article_child")
    under = F.col("source_node_id").startswith(F.concat(F.regexp_replace("parent_article_id", ":article:", ":paragraph:"), F.lit(":"))) | (F.col("source_node_id") == F.col("parent_article_id"))
    blank = F.trim(F.coalesce("retrieval_text", F.lit(""))) == ""
    # of an id: how many parents and children have it, how many children name it as theirs, and the faults of those that have it
    said = lambda key, *n: F.struct(key.alias("id"), *(x.cast("long").alias(k) for k, x in zip(("parents", "children", "named", "empty_parents", "empty_children", "mismatched"), n, strict=True)))
    none = F.lit(0)
    own = said(F.col("chunk_id"), parent, child, none, parent & blank, child & blank, F.coalesce(child & ~under, F.lit(False)))
    up = said(F.col("parent_article_id"), none, none, child, none, none, none)
    told = chunks.where(parent | child).select(F.explode(F.when(child, F.array(own, up)).otherwise(F.array(own))).alias("x")).select("x.*")
    ids = told.groupBy("id").agg(*(F.sum(c).alias(c) for c in told.columns[1:]))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    known = F.col("id").isNotNull()  # a null is no one's id and each more than one
    twice = lambda c: F.col(c) - F.when((F.col(c) > 0) & known, 1).otherwise(0)
    return ids.agg(
        total(twice("parents"), "duplicate_parent_ids"),
        total(F.col("empty_parents"), "empty_parents"),
        total(twice("children"), "duplicate_child_ids"),
        total(F.col("empty_children"), "empty_children"),
        total(F.col("mismatched"), "mismatched_links"),
        total(F.when(~known | (F.col("parents") == 0), F.col("named")), "missing_parents"),
        total(F.when(~known | (F.col("named") == 0), F.col("parents")), "childless_parents"),
    )
