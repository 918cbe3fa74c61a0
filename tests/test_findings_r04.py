"""What the fourth round's findings were about: work that was done more than once, and results of what now does it once."""

import html
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import statutes, summaries


def plan(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_payloads_are_parsed_below_python_alone(spark):
    """What stands above Python's step is of the read text; the payload is not made and parsed for the id once more."""
    d = spark.createDataFrame([("{}", "7")], "p string, i string")
    none = F.lit(None).cast("string")
    above, below = plan(d.select(summaries.summary_check(F.col("p"), F.col("i"), F.col("i"), none, none).alias("c")).select("c.*")).split("ArrowEvalPython", 1)
    assert "parseJson" not in above and "parseJson" in below
    assert "regexp_replace" not in above + below


ATOMS = ["<br/>", "<br", "<", ">", "/>", "</p>", "</P\t>", "<BR />", "&nbsp;", "&", "&amp;", "&lt", "nbsp;", "&l", "t;", "\x1c", "\n", "\n\n\n", " ", "\t", "\r", "\x0b", "가", "a", "&#38;", "#160;", "　", "\x85", " ", "/", "p", "&copy"]


def test_markup_is_read_by_its_rules(spark):
    """Breaks, tags, references and white space in any order, in parts of a batch: the rules one after the other in plain Python."""
    r = random.Random(4)
    texts = [None if i % 40 == 0 else "".join(r.choice(ATOMS) for _ in range(r.randrange(14))) for i in range(20 * T.PART + 3)]

    def read(t):
        t = re.sub(r"<[^>]+>", " ", re.sub(r"(?i)<br[ \t-\r]*/?>|</p[ \t-\r]*>", "\n", t or ""))
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t\r\f\x0b]+", " ", html.unescape(t).replace("\xa0", " "))).strip()

    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = d.select("i", T.body_normalised(F.col("t")).alias("body"), T.body_line(F.col("t"), F.col("t")).alias("x")).orderBy("i").collect()
    for g, t in zip(got, texts, strict=True):
        assert (g.body, g.x.line, g.x.beside) == (read(t), " ".join(read(t).split()), t)


def chunks_of(a, groups):
    """All chunks of one article in plain Python."""
    name = f"{a.label}({a.title.strip()})" if a.title and a.title.strip() else a.label
    body = (a.text.removeprefix(name).strip() if a.text else "") or None
    top = [f"법령: {a.law_name}", *([f"구조: {' > '.join(a.headings)}"] if a.headings else []), f"조문: {name}"]
    shown = lambda lines, unit=None: "\n".join([*top, *([f"검색 단위: {unit}"] if unit else []), "", "본문:", *lines]).strip()
    paragraphs = sorted(a.paragraphs, key=lambda p: p.ord)
    whole = [*([body] if body else []), *(t for p in paragraphs for t in p.texts)]
    if groups is None:
        yield a.node_id, a.node_id, None, "article", shown(whole), None, None, None, None
    for k, group in enumerate(groups or [], 1):
        own = [*([body] if body and k == 1 else []), *(t for p in paragraphs if p.ord in group for t in p.texts)]
        yield f"{a.node_id}:part:{k:02d}", a.node_id, None, "article_part", shown(own), k, len(groups), tuple(sorted(group)), None
    children = [(p.node_id, p.node_id, "paragraph_child", shown([*([body] if body else []), *p.texts], f"{a.label} {p.label or f'제{p.ord}항'}"), p.ord) for p in paragraphs if p.texts]
    if not children and body:
        children = [(f"{a.node_id}:child", a.node_id, "article_child", shown([body], a.label), None)]
    if not children:
        yield None, a.node_id, None, "excluded", None, None, None, None, None
        return
    yield a.node_id, a.node_id, None, "article_parent", shown(whole), None, None, None, None
    for chunk, source, kind, text, order in children:
        yield chunk, source, a.node_id, kind, text, None, None, None, order


ARTICLE = "law_id string, law_name string, node_id string, label string, title string, text string, headings array<string>, paragraphs array<struct<node_id: string, ord: int, label: string, texts: array<string>>>"


def test_chunks_of_odd_articles(spark):
    r = random.Random(8)
    rows, groups = [], []
    for i in range(120):
        own = f"law:1:article:{i:04d}"
        orders = list(range(1, r.choice([1, 2, 4, 5, 130 if i == 7 else 6])))
        r.shuffle(orders)
        ps = [(f"law:1:paragraph:{i:04d}:{o:04d}", o, r.choice([None, "", "①"]), r.choice([[], ["가 "], ["나\u3000", "다\xa0\u2003"], [""]])) for o in orders]
        title = r.choice([None, "", "\u3000 ", " 목적\xa0"])
        name = f"제{i}조(목적)" if title and title.strip() else f"제{i}조"
        rows.append(("1", "주택법", own, f"제{i}조", title, r.choice([None, "", name, name + " 이 법은 ", "이 법은\u2028", "\x1c"]), r.choice([[], ["제1장"], ["제1장", "제1절"]]), ps))
        if r.random() < 0.5 or i == 7:
            cut = r.randrange(len(orders) + 1)
            parts = [[o] for o in orders] if i == 7 else [g for g in (orders[:cut], orders[cut:]) if g]
            groups.append((own, parts))
    d = spark.createDataFrame(rows, ARTICLE)
    got = statutes.article_chunks(d, spark.createDataFrame(groups, "node_id string, groups array<array<int>>"))
    assert [f.dataType.simpleString() for f in got.schema] == ["string"] * 6 + ["int", "int", "array<int>", "int"]
    by = dict(groups)
    want = Counter(c for a in d.collect() for c in chunks_of(a, by.get(a.node_id)))
    beside = d.join(spark.createDataFrame(groups, "node_id string, g array<array<int>>"), "node_id", "left")
    for made in (got, statutes.article_chunks(beside, F.col("g"))):
        assert Counter(tuple(tuple(v) if isinstance(v, list) else v for v in row[1:]) for row in made.collect()) == want


def test_chunk_faults_read_chunks_once(spark):
    """One scan of the chunks, and the counts of any rows: ids that repeat or are null, lost parents, parents alone, blanks, foreign sources."""
    r = random.Random(9)
    name = lambda kind: r.choice([None, *(f"law:1:{kind}:{i:04d}" for i in range(9))])
    rows = []
    for _ in range(60):
        kind, parent = r.choice(["article", "article_parent", "paragraph_child", "article_child", "excluded"]), name("article")
        up = None if kind == "article_parent" else parent
        source = r.choice([None, up, (parent or "law:1:article:0001").replace("article", "paragraph") + ":0001", "law:2:paragraph:0001:0001"])
        rows.append((name("article" if kind == "article_parent" else "paragraph"), source, up, kind, r.choice([None, "", "  ", "x"])))
    d = spark.createDataFrame(rows, "chunk_id string, source_node_id string, parent_article_id string, chunk_type string, retrieval_text string")
    parents, children = [x for x in rows if x[3] == "article_parent"], [x for x in rows if x[3].endswith("_child")]
    twice = lambda xs: len(xs) - len({x[0] for x in xs} - {None})
    blank = lambda xs: sum(not (x[4] or "").strip(" ") for x in xs)
    foreign = [x for x in children if x[1] is not None and x[2] is not None and not (x[1] == x[2] or x[1].startswith(x[2].replace(":article:", ":paragraph:") + ":"))]
    had, named = {x[0] for x in parents} - {None}, {x[2] for x in children} - {None}
    got = statutes.chunk_faults(d)
    want = (twice(parents), blank(parents), twice(children), blank(children), len(foreign), sum(x[2] not in had for x in children), sum(x[0] not in named for x in parents))
    assert tuple(got.first()) == want and min(want) > 0
    assert plan(got).count("LogicalRDD") + plan(got).count("LocalRelation") == 1
    assert set(statutes.chunk_faults(d.where("false")).first()) == {0}
