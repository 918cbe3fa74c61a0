"""Dictionary matching: an automaton over a broadcast dictionary, greedy choice of spans, token alignment, rule cascades."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries that a dictionary sent to every task may have.
MOST_KEYS = 500_000


class Automaton:
    """All occurrences of any key in one pass over a text."""

    def __init__(self, keys):
        self.found = ahocorasick.Automaton()
        for key in set(keys) - {""}:
            self.found.add_word(key, key)
        if len(self.found):
            self.found.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, str]]:
        if len(self.found):
            for last, key in self.found.iter(text):
                yield last + 1 - len(key), last + 1, key


def hangul(c: str) -> bool:
    return "가" <= c <= "힣"


def inside_word(text: str, start: int, key: str) -> bool:
    """Whether a key of two syllables stands behind another syllable, where it is likely a part of a longer word."""
    return len(key) == 2 and all(map(hangul, key)) and start > 0 and hangul(text[start - 1])


def apart(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of overlapping spans the longest, then the first, then the least key; in text order."""
    kept: list[tuple[int, int, str]] = []
    for span in sorted(spans, key=lambda x: (x[0] - x[1], x[0], x[2])):
        at = bisect.bisect_left(kept, span[:2])
        # kept spans are apart, so only the neighbours can overlap
        if (at == 0 or kept[at - 1][1] <= span[0]) and (at == len(kept) or kept[at][0] >= span[1]):
            kept.insert(at, span)
    return kept


def match_terms(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: bool = True) -> DataFrame:
    """(id, start, end, key) of the keys (one column, up to MOST_KEYS) found in each text; the longest that do not overlap."""
    keys = [r[0] for r in terms.where("key is not null").select("key").distinct().limit(MOST_KEYS + 1).collect()]
    if len(keys) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys: match them in parts")
    sent = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(sent.value)
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = [x for x in automaton.find(text or "") if not inside_word(text, x[0], x[2])]
                out += [(i, *x) for x in (apart(spans) if longest else spans)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["id", "start", "end", "key"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id long, start int, end int, key string")


def group_signal(text: Column, for_terms: list[str], against_terms: list[str]) -> Column:
    """mixed, strong_for, strong_against or neutral: one hit for, two against are strong."""
    hits = lambda terms: F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t)))
    a, b = hits(for_terms) >= 1, hits(against_terms) >= 2
    return F.when(a & b, "mixed").when(a, "strong_for").when(b, "strong_against").otherwise("neutral")


def occurrences(text: Column, pattern: str) -> Column:
    """Begins (from 0) of a fixed string, overlapping ones too."""
    n = F.length(text) - len(pattern)
    return F.when(n >= 0, F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.substring(text, i + 1, F.lit(len(pattern))) == pattern)).otherwise(F.expr("cast(array() as array<int>)"))
