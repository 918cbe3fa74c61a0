"""Term dictionaries: groups of spellings, merged sources, definitions, components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.matching import apart


def matchable(key: Column, script: str, least: int = 2) -> Column:
    """Whether a key is long enough to be looked for and has a letter of the script (a character class)."""
    return (F.length(key) >= least) & key.rlike(script)


def representative(variants: Column, spaced: str, openings: str) -> Column:
    """Of spellings the one with letters apart (a pattern), then not begun by punctuation (a class), then shortest, then least."""
    rank = lambda t: F.struct((~t.rlike(spaced)).alias("a"), t.rlike(f"^{openings}").alias("b"), F.length(t).alias("n"), t.alias("t"))
    return F.array_min(F.transform(variants, rank))["t"]


def term_groups(rows: DataFrame, key: Column, spaced: str, openings: str) -> DataFrame:
    """Rows (term, codes: comma list) by key: term (the representative), variants and codes in order, entries."""
    code = F.explode_outer(F.filter(F.transform(F.split("codes", ","), lambda c: F.trim(c)), lambda c: c != ""))
    d = rows.select(key.alias("key"), "term", F.monotonically_increasing_id().alias("_id"), "codes")
    # sets by key hold distinct spellings and codes, not rows
    g = d.groupBy("key").agg(F.array_sort(F.collect_set("term")).alias("variants"), F.count(F.lit(1)).alias("entries"))
    c = d.select("key", code.alias("code")).groupBy("key").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    return g.join(c, "key").select("key", representative(F.col("variants"), spaced, openings).alias("term"), "variants", "codes", "entries")


def numeric_first(value: Column) -> list[Column]:
    """An order of texts: numbers by value, then the others as text."""
    number = value.rlike("^[0-9]+$")
    return [~number, F.when(number, value.cast("decimal(38,0)")), value]


def merged_sources(rows: DataFrame) -> DataFrame:
    """Rows (key, term, source_id, place, article, occurrences) by key: each source counts once, the first of an id.

    variants, documents (places that are named), articles (distinct pairs that name something), occurrences.
    """
    first = F.row_number().over(Window.partitionBy("key", "source_id").orderBy("seq"))
    s = rows.withColumn("_n", first).where("_n = 1")
    named = (F.coalesce("place", F.lit("")) != "") | (F.coalesce("article", F.lit("")) != "")
    counts = s.groupBy("key").agg(F.countDistinct(F.nullif("place", F.lit(""))).alias("documents"), F.countDistinct(F.when(named, F.struct("place", "article"))).alias("articles"), F.sum("occurrences").alias("occurrences"))
    variants = rows.groupBy("key").agg(F.array_sort(F.collect_set("term")).alias("variants"))
    return variants.join(counts, "key")


def identical_texts(rows: DataFrame, text: str, sets: list[str]) -> DataFrame:
    """Rows whose text is the same as one; of each other column the distinct non-empty values in order. Empty texts are left out."""
    d = rows.where(F.coalesce(text, F.lit("")) != "")
    return d.groupBy(text).agg(*(F.array_sort(F.collect_set(F.nullif(F.col(c).cast("string"), F.lit("")))).alias(c) for c in sets))


def patterns(groups: DataFrame, normal: Column) -> DataFrame:
    """(pattern, key): the key itself and each variant's normal form; a pattern of several keys names the last key."""
    own = groups.select(F.col("key").alias("pattern"), "key")
    more = groups.select(F.explode("variants").alias("variant"), "key").select(normal.alias("pattern"), "key").where("pattern <> ''")
    return own.union(more).groupBy("pattern").agg(F.max("key").alias("key"))


def not_known(candidates: DataFrame, *known: DataFrame, key: str = "key") -> DataFrame:
    """Candidates whose key no known table has."""
    for k in known:
        candidates = candidates.join(k.select(key), key, "left_anti")
    return candidates


def runs_of(tags: Column, words: Column, wanted: str, most: int = 4) -> Column:
    """(component, size) for each 1 to `most` words in a row whose tags all match a pattern, words joined."""
    i = F.sequence(F.lit(0), F.size(words) - 1)
    sizes = F.sequence(F.lit(1), F.lit(most))
    all_of = F.flatten(F.transform(i, lambda a: F.transform(sizes, lambda n: F.struct(a.alias("a"), n.alias("n")))))
    fits = F.filter(all_of, lambda x: (x["a"] + x["n"] <= F.size(words)) & F.forall(F.slice(tags, x["a"] + 1, x["n"]), lambda t: t.rlike(wanted)))
    found = F.transform(fits, lambda x: F.struct(F.array_join(F.slice(words, x["a"] + 1, x["n"]), "").alias("component"), x["n"].alias("size")))
    return F.when(F.size(words) > 0, found).otherwise(F.expr("cast(array() as array<struct<component:string,size:int>>)"))


def components(terms: DataFrame, tags: Column, words: Column, whole: Column, wanted: str, most: int = 4, least: int = 2) -> DataFrame:
    """(key, component, methods) of terms (key, ..): runs of wanted words of `least` characters and more that are not the whole key.

    methods, in order: token for a run of one word, ngram for a longer one; a component may come about both ways.
    """
    d = terms.select("key", whole.alias("_whole"), F.explode(runs_of(tags, words, wanted, most)).alias("x"))
    d = d.select("key", "_whole", "x.component", F.when(F.col("x.size") == 1, "token").otherwise("ngram").alias("method"))
    d = d.where((F.length("component") >= least) & (F.col("component") != F.col("_whole")))
    return d.groupBy("key", "component").agg(F.array_sort(F.collect_set("method")).alias("methods"))


def user_selection(term: Column, included: Column, wanted: list[str], unwanted: list[str], common: list[str], named: Column) -> Column:
    """A struct (decision, reason): what users ask for or refuse goes before everything, also before an earlier exclusion
    (`included` not true); then common words and names of laws go, and all others stay. A term on both lists is wanted."""
    rules = [
        (term.isin(wanted), "selected", "user_selected"),
        (term.isin(unwanted), "excluded", "user_excluded"),
        (~F.coalesce(included, F.lit(False)), "excluded", "excluded_before"),
        (term.isin(common), "excluded", "common_word"),
        (F.coalesce(named, F.lit(False)), "excluded", "statute_name"),
    ]
    out = F
    for rule, decision, reason in rules:
        out = out.when(rule, F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason")))
    return out.otherwise(F.struct(F.lit("selected").alias("decision"), F.lit("kept_in_doubt").alias("reason")))


def cover(parents: DataFrame) -> DataFrame:
    """Of (parent, components: array) the components chosen to cover the parent: longest first, then leftmost, none overlapping.

    Columns parent, component, start, end. All places of a component count, overlapping ones too. One parent's components,
    which are bounded by its own length, meet in one row.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parent, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = []
                for c in sorted(set(parts or ())):
                    at = parent.find(c) if c else -1
                    while at >= 0:
                        spans.append((at, at + len(c), c))
                        at = parent.find(c, at + 1)
                taken = apart(spans)
                out += [(parent, c, a, z) for a, z, c in sorted(taken)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=["parent", "component", "start", "end"])

    return parents.select("parent", "components").mapInArrow(run, "parent string, component string, start int, end int")


def one_match(rows: DataFrame, dictionary: DataFrame, key: str, text: str) -> DataFrame:
    """Adds matches and definition_id: of the dictionary's entries of the key those with exactly this text; none unless one."""
    n = dictionary.groupBy(key, text).agg(F.count(F.lit(1)).alias("matches"), F.min("definition_id").alias("definition_id"))
    d = rows.join(n, [key, text], "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return d.withColumn("definition_id", F.when(F.col("matches") == 1, F.col("definition_id")))
