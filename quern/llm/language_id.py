"""Language identification: nearest of several centroids a language, over TF-IDF weighted character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._common import docs_of, prepare, working

#: Hashed n-gram features.
BINS = 4096
#: Labelled rows that the centroids are fitted on: at most this many over all languages, and of a language.
SAMPLE_ROWS, SAMPLE_A_LANGUAGE = 4000, 600
#: Centroids a language, and rounds of their clustering.
CENTROIDS, ROUNDS = 4, 12
#: How far beyond nearly all training texts of a centroid a text may be before it is rejected.
REJECT_QUANTILE, REJECT_MARGIN = 0.995, 1.3
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def _bins(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(20)


def gram_counts(texts: list[str]) -> np.ndarray:
    """Counts [text, bin] of letters, pairs and triples around each letter of the lower-cased text; others are spaces."""
    raw = [np.frombuffer((" " + t.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(r) for r in raw])
    cp = np.concatenate(raw)
    is_letter = letters()[cp]
    cp = np.where(is_letter, cp, np.uint32(32))
    at = np.flatnonzero(is_letter)
    doc = np.repeat(np.arange(len(texts)), sizes)[at] * BINS
    before, here, after = cp[at - 1], cp[at] * np.uint32(0x85EBCA77), cp[at + 1]
    pair = before * np.uint32(0x9E3779B1) + here
    out = np.zeros(len(texts) * BINS, np.int64)
    for h in (pair + after * np.uint32(0xC2B2AE3D), pair ^ np.uint32(0x5BD1E995), here ^ np.uint32(0x27D4EB2F)):
        out += np.bincount(doc + _bins(h), minlength=len(out))
    return out.reshape(len(texts), BINS).astype(np.float32)


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray  # the language of each centroid
    radius: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, cosine distance to its centroid, rejected) of each text."""
        counts = gram_counts(texts)
        has = counts.sum(1) > 0
        cos = self.vectors(counts) @ self.centroids.T
        near = cos.argmax(1)
        by_lang = np.stack([cos[:, self.owner == k].max(1) for k in range(len(self.langs))], 1)
        e = np.exp(20 * (by_lang - by_lang.max(1, keepdims=True)))
        score = e.max(1) / e.sum(1)
        out = []
        for i, k in enumerate(near):
            if has[i]:
                far = max(0.0, 1 - float(cos[i, k]))
                out.append((self.langs[self.owner[k]], float(score[i]), far, far > float(self.radius[k])))
            else:
                out.append((UNKNOWN, 0.0, None, True))
        return out


def cluster(v: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids by spherical k-means, begun from the texts that are farthest from those chosen before."""
    k = min(k, len(v))
    mean = v.mean(0)
    chosen = [int((v @ mean).argmax())]
    while len(chosen) < k:
        chosen.append(int((v @ v[chosen].T).max(1).argmin()))
    c = v[chosen]
    for _ in range(ROUNDS):
        own = (v @ c.T).argmax(1)
        c = np.stack([v[own == j].sum(0) if (own == j).any() else c[j] for j in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(counts: np.ndarray, labels: list[str]) -> LanguageModel:
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    langs = sorted(set(labels))
    model = LanguageModel(langs, idf, np.empty(0), np.empty(0, int), np.empty(0))
    v, y = model.vectors(counts), np.array(labels)
    found, owner, radius = [], [], []
    for k, lang in enumerate(langs):
        own = v[y == lang]
        c = cluster(own, CENTROIDS)
        cos = own @ c.T
        near = cos.argmax(1)
        for j in range(len(c)):
            far = 1 - cos[near == j, j]
            radius.append(max(0.05, REJECT_MARGIN * float(np.quantile(far, REJECT_QUANTILE))) if len(far) else 0.05)
        found.append(c)
        owner += [k] * len(c)
    model.centroids, model.owner, model.radius = np.concatenate(found), np.array(owner), np.array(radius)
    return model


def share_below(wanted: int, of: int) -> int:
    """The 62-bit hash below which about `wanted` of `of` rows lie, and surely not fewer where hashes are even: with eight deviations to spare."""
    spare = wanted + 8 * int(wanted**0.5) + 32
    return 2**62 if spare >= of else (2**62 * spare) // of


def _drawn(rows: DataFrame, by: str, counts: dict, each: int, seed: int) -> DataFrame:
    """Of each value of `by` with `counts` rows the `each` rows of the smallest hashes of the id, ties by the hash of the whole row.

    Hashes first say which rows can be among them, so that about `each` rows of a value are sorted; each task keeps no more than
    `each` of a value before rows travel, also where one id stands in a third of the rows.
    """
    h = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 2)
    near = F.lit(False)
    for value, n in counts.items():
        near = near | ((F.col(by) == F.lit(value)) & (h < F.lit(share_below(each, n))))
    w = Window.partitionBy(by).orderBy("_h", "_tie")
    d = rows.where(near).withColumn("_h", h).withColumn("_tie", F.xxhash64(*rows.columns))
    return d.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= each).select(*rows.columns)


def _sample(rows: DataFrame, by: str, most: int, most_each: int, seed: int) -> DataFrame:
    """At most `most` rows, evenly over the values of `by`, whatever the size of `rows`. One count for each value comes to the driver."""
    counts = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}
    return _drawn(rows, by, counts, max(1, min(most_each, most // max(1, len(counts)))), seed)


def fit_language_model(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """Fit on at most SAMPLE_ROWS of the rows where `train` holds and the language is not null; None if no text has a letter.

    Only gram counts of the sample (16 KB a text) come to the driver.
    """
    prepare(docs.sparkSession)
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("label"), F.col(text_col).alias("text"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in docs_of(batch.select(["label", "text"])):
                for i in range(0, len(ids), 256):
                    counts = gram_counts(texts[i : i + 256])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 256], pa.string()), pa.array([c.tobytes() for c in counts.astype("<f4")], pa.binary())], names=["label", "counts"])

    got = _sample(rows, "label", SAMPLE_ROWS, SAMPLE_A_LANGUAGE, 7).select("label", "text").mapInArrow(run, "label string, counts binary").collect()
    got = sorted((r[0], bytes(r[1])) for r in got)
    counts = np.stack([np.frombuffer(c, "<f4") for _, c in got]) if got else np.empty((0, BINS), np.float32)
    has = counts.sum(1) > 0
    return fit(counts[has], [r[0] for r, x in zip(got, has, strict=True) if x]) if has.any() else None


def predict_language(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, distance, rejected of each row, over its whole text; one pass, no shuffle.

    `und` with score 0 for a null text or one without a letter (and for all without a model); `rejected` says that the nearest
    centroid is farther than nearly all texts it was learned from. Ids, null or repeated, are passed on.
    """
    prepare(docs.sparkSession)

    def run(batches) -> Iterator[pa.RecordBatch]:
        working("language")
        for batch in batches:
            for ids, texts in docs_of(batch):
                for i in range(0, len(ids), 256):
                    some = texts[i : i + 256]
                    got = model.predict(some) if model else [(UNKNOWN, 0.0, None, True)] * len(some)
                    cols = list(zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 256], pa.int64()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())], names=["doc_id", "lang_pred", "score", "distance", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, distance double, rejected boolean")


def language_id(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the rows where `train` holds, then predict every row, as predict_language() says; null ids may not be learned from.

    Where no row can be learned from, an empty table too, every row is `und`.
    """
    return predict_language(docs, fit_language_model(docs, train, id_col, text_col, lang_col), id_col, text_col)
