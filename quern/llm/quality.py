"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._common import Cache, hash64, holds, prepare, text_runs, work_table, working
from quern.llm.language_id import _sample

#: Buckets of words and of word shapes, and dimensions of their vectors.
WORDS, SHAPES, DIM = 16384, 1024, 48
#: Ones of either sign in an index vector; words on each side that count as context.
ONES, REACH = 6, 2
#: Labelled documents that vectors and network are fitted on: about this many, half of each label if there are enough.
SAMPLE_ROWS = 8000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 3e-3, 1e-4
REPEAT = WORDS  # the shape of a word that equals the one before

_RUNS = [(regex.compile(r"\p{Lu}+"), "A"), (regex.compile(r"\p{Ll}+"), "a"), (regex.compile(r"\p{L}{2,}"), "a"), (regex.compile(r"\p{N}+"), "0"), (regex.compile(r"([^\p{L}\p{N}])\1{2,}"), r"\1\1\1")]
_NOT_LETTER = regex.compile(r"[^\p{L}]+")


def word_codes(part: str) -> int:
    """Bucket of the word's letters, lower-cased, and bucket of its shape (runs of capitals, small letters, digits)."""
    core = _NOT_LETTER.sub("", part).lower()
    shape = part
    for pattern, to in _RUNS:
        shape = pattern.sub(to, shape)
    shape = shape[:12]
    return (hash64(core) % WORDS if core else hash64("\0" + shape) % WORDS) << 16 | (WORDS + 1 + hash64(shape) % (SHAPES - 1))


_CODES = Cache(word_codes)
holds("quality", _CODES.clear)


def codes_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Of each text word buckets, shape buckets and the share of non-empty lines that repeat one before."""
    lists = pc.utf8_split_whitespace(texts)
    coded, sizes = lists.flatten().dictionary_encode(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    parts = coded.dictionary.to_pylist()
    known = np.fromiter((_CODES[p] if p else -1 for p in parts), np.int64, len(parts))
    which = coded.indices.to_numpy(zero_copy_only=False)
    end = 0
    for text, n in zip(texts.to_pylist(), sizes.tolist(), strict=True):
        own = which[end : end + n]
        end += n
        both = known[own]
        own, both = own[both >= 0], both[both >= 0]  # white space at the ends gives empty parts
        words, shapes = both >> 16, both & 0xFFFF
        shapes[1:][own[1:] == own[:-1]] = REPEAT
        full = [x for x in text.split("\n") if x.strip()]
        yield words, shapes, 1 - len(set(full)) / len(full) if full else 0.0


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(20)
    out = np.zeros((WORDS + SHAPES, DIM), np.float32)
    at = np.argsort(rng.random(out.shape), axis=1)[:, :ONES]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), at.shape), axis=1)
    return out


def context_sums(texts: pa.Array, index: np.ndarray) -> np.ndarray:
    """For each bucket the sum of the index vectors around its occurrences."""
    out = np.zeros((WORDS + SHAPES, DIM))
    for words, shapes, _ in codes_of(texts):
        for start in range(0, len(words), 100_000):
            w, s = words[start : start + 100_000], shapes[start : start + 100_000]
            own = index[w] + index[s]
            around = index[s].copy()
            for d in range(1, REACH + 1):
                around[d:] += own[:-d]
                around[:-d] += own[d:]
            for key in (w, s):
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                out[key[order][first]] += np.add.reduceat(around[order], first, axis=0)
    return out.astype(np.float32)


def word_vectors(sums: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Unit vectors: a bucket's context, without what all share, and a part of its own index vector; the latter if unseen."""
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    seen = norm[:, 0] > 0
    unit = np.where(norm > 0, sums / np.maximum(norm, 1e-9), 0)
    unit[seen] -= unit[seen].mean(0) if seen.any() else 0
    own = index / np.sqrt(ONES)
    out = np.where(seen[:, None], unit + 0.5 * own, own)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A document's mean word vector, mean shape vector, log length, share of repeated words and of repeated lines."""
    out = np.zeros((len(texts), 2 * DIM + 3), np.float32)
    for i, (words, shapes, again) in enumerate(codes_of(texts)):
        n = len(words)
        for start in range(0, n, 200_000):
            out[i, :DIM] += vectors[words[start : start + 200_000]].sum(0)
        out[i, DIM : 2 * DIM] = np.bincount(shapes - WORDS, minlength=SHAPES).astype(np.float32) @ vectors[WORDS:]
        out[i, : 2 * DIM] /= max(n, 1)
        out[i, 2 * DIM :] = np.log1p(n), (shapes == REPEAT).mean() if n else 0, again
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, texts: pa.Array) -> np.ndarray:
        z = self.logits(pooled(texts, self.vectors).astype(np.float64)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, vectors: np.ndarray) -> QualityModel:
    """Adam on weighted cross-entropy over four fifths; the last fifth sets the temperature."""
    rng = np.random.default_rng(3)
    order = rng.permutation(len(x))
    held, own = order[: len(x) // 5], order[len(x) // 5 :]
    m = QualityModel(vectors, x[own].mean(0), x[own].std(0) + 1e-3, rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), 0.0)
    z = (x - m.mean) / m.scale
    p = [m.w1, m.b1, m.w2, np.array([m.b2])]
    moment, square, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(EPOCHS):
        rng.shuffle(own)
        for i in range(0, len(own), BATCH):
            k = own[i : i + BATCH]
            h = z[k] @ p[0] + p[1]
            a = np.maximum(h, 0)
            out = 1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -60, 60)))
            d = (out - y[k]) * weight[k] / len(k)
            back = np.outer(d, p[2]) * (h > 0)
            grads = [z[k].T @ back + DECAY * p[0], back.sum(0), a.T @ d + DECAY * p[2], np.array([d.sum()])]
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for j, g in enumerate(grads):
                moment[j] = 0.9 * moment[j] + 0.1 * g
                square[j] = 0.999 * square[j] + 0.001 * g * g
                p[j] = p[j] - rate * (moment[j] / (1 - 0.9**step)) / (np.sqrt(square[j] / (1 - 0.999**step)) + 1e-8)
    m.w1, m.b1, m.w2, m.b2 = p[0], p[1], p[2], float(p[3][0])
    if len(held):
        lz = m.logits(x[held])
        grid = np.geomspace(0.25, 8, 60)
        loss = [(weight[held] * (np.logaddexp(0, lz / t) - y[held] * lz / t)).mean() for t in grid]
        m.temperature = float(grid[int(np.argmin(loss))])
    return m


def fit_quality(docs: DataFrame, labels: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel | None:
    """Fit on at most SAMPLE_ROWS labelled documents where `train_rows` holds (an expression of the labels' id column).

    The sample takes both labels evenly and weighs them back to their true shares, so that probabilities stay calibrated. Its
    ids, at most SAMPLE_ROWS, are broadcast to the documents; sums of 3 MB for each of four tasks and pooled vectors
    come to the driver. A document with several labels has the least; null ids and labels are left out. None if one label or
    no document is found.
    """
    spark = prepare(docs.sparkSession)
    rows = labels.where(train_rows & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("int").alias("label"))
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    picked = _sample(rows, "label", SAMPLE_ROWS, SAMPLE_ROWS // 2, 11)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = work_table(spark, texts.join(F.broadcast(picked), "doc_id").repartition(4, "doc_id").select("doc_id", "text", "label"), "quality-sample")
    index = index_vectors()

    def sums(batches) -> Iterator[pa.RecordBatch]:
        working("quality")
        total = np.zeros_like(index)
        for batch in batches:
            total += context_sums(batch.column(0), index)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f4").tobytes()], pa.binary())], names=["sums"])

    total = np.zeros_like(index)
    for r in sample.select("text").mapInArrow(sums, "sums binary").toLocalIterator():
        total += np.frombuffer(r[0], "<f4").reshape(index.shape)
    vectors = word_vectors(total, index)

    def features(batches) -> Iterator[pa.RecordBatch]:
        working("quality")
        for batch in batches:
            x = pooled(batch.column(1), vectors)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.int32()), pa.array([v.tobytes() for v in x.astype("<f4")], pa.binary())], names=["doc_id", "label", "x"])

    got = sorted((r[0], r[1], bytes(r[2])) for r in sample.mapInArrow(features, "doc_id long, label int, x binary").collect())
    y = np.array([r[1] for r in got], float)
    if len(set(y.tolist())) < 2:
        return None
    x = np.stack([np.frombuffer(r[2], "<f4") for r in got]).astype(np.float64)
    share = {k: (y == k).mean() * sum(counts.values()) / n for k, n in counts.items()}
    return train(x, y, np.array([1 / share[int(k)] for k in y]), vectors)


def score_quality(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted (1 if score >= threshold) of each row, over its whole text; one pass, no shuffle.

    Null texts count as empty. Without a model each score is 0.5. Ids, null or repeated, are passed on; other columns are not
    read; an empty table gives an empty one.
    """
    prepare(docs.sparkSession)

    def run(batches) -> Iterator[pa.RecordBatch]:
        working("quality")
        for batch in batches:
            for row, texts in text_runs(batch, 1):
                score = model.score(texts) if model else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel | None, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores `threshold` or more; all rows without a model. One pass, no shuffle.

    Rows are judged by their text alone, whatever their id; null texts count as empty. An empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches) -> Iterator[pa.RecordBatch]:
        working("quality")
        for batch in batches:
            score = [model.score(texts) for _, texts in text_runs(batch, at)]
            if score:
                yield batch.filter(pa.array(np.concatenate(score) >= threshold))

    return docs.mapInArrow(run, docs.schema) if model else docs
