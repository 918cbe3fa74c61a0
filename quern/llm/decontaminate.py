"""Benchmark decontamination: CGK embedding and bit-sampling LSH over item-sized windows, then exact word edit distance.

An item of L words leaks where its words and a stretch of a document's are within floor(RATE * L) edits; items under SHORT
words must stand there unchanged. Items of more than MOST_PART words are cut into parts; where the item leaks, one of its
parts stands with no more edits for its size. A part's window in a text is embedded by a CGK walk: at each step a random bit
of (step, word) says whether to go on to the next word, so a few edits change few places of the walk. Words at PLACES sampled
places make a signature; REPEATS walks of their own give as many hash tables, and the buckets of a window's signatures name
the parts, hence items, that it is compared with. What they name is checked exactly: the words shared, then the least edit
distance of the item to any stretch around the window.

Windows are looked at only where the text has a piece of some part unchanged. That gate loses nothing: a part of L words cut
into floor(RATE * L) + 1 pieces has one unchanged. The tables may lose a leak; README has their measured recall.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._common import Cache, hash64, holds, mix, prepare, shingles, text_runs, working

#: Edits a word that still count as the item; items under SHORT words must stand there unchanged.
RATE, SHORT = 0.2, 8
#: Words of the longest part and of parts of longer items; walks (tables) and sampled places of each.
MOST_PART, PART, REPEATS, PLACES = 64, 32, 32, 2
GRAM = 4
#: Cells of a row of edit distances that are computed side by side, over all windows; windows that are embedded at a time.
CELLS, WINDOWS = 400_000, 4096
#: Items that one pass takes; a larger benchmark is searched in as many passes.
BLOCK_ITEMS = 50_000
FIELD_BITS = 22

_OUTER = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")


def _word_hash(part: str) -> int:
    core = _OUTER.sub("", part.lower())
    return (hash64(core) or 1) if core else 0


_HASH = Cache(_word_hash)
holds("decontaminate", _HASH.clear)


def word_hashes(texts: pa.Array) -> list[np.ndarray]:
    """Of each text the hashes of its words: lower-cased, without what is neither letter nor digit at their ends; others are skipped."""
    lists = pc.utf8_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    known = np.fromiter(map(_HASH.__getitem__, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h, own = known[coded.indices.to_numpy(zero_copy_only=False)], pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    h, own = h[h > 0], own[h > 0]
    return np.split(h, np.cumsum(np.bincount(own, minlength=len(texts)))[:-1])


def cut(words: np.ndarray, begin: np.ndarray, low: np.ndarray | int, high: np.ndarray | int, width: int) -> np.ndarray:
    """Rows of `width` words from each begin; zeros outside of low to high."""
    at = begin[:, None] + np.arange(width)
    inside = (at >= np.reshape(low, (-1, 1))) & (at < np.reshape(high, (-1, 1)))
    return np.where(inside, words[np.clip(at, 0, len(words) - 1)], np.uint64(0))


# ---- CGK embedding and its tables ----


def size_class(size: int) -> int:
    """The least size of a part's class: a power of two."""
    return 1 << (size.bit_length() - 1)


def steps_of(least: int) -> int:
    """Steps of a class's walks, which are then at word 0.75 * least on average, before the end of its shortest part."""
    return max(1, least + least // 2)


def _plan(least: int) -> tuple[np.ndarray, np.ndarray]:
    """The walks' multipliers [step, repeat], whose products' first bits say whether to go on, and sampled steps [repeat, place]."""
    rng = np.random.default_rng([29, least])
    odd = rng.integers(0, 1 << 63, (steps_of(least), REPEATS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, steps_of(least), (REPEATS, PLACES))


def signatures(windows: np.ndarray, least: int) -> np.ndarray:
    """Of windows [n, steps of the class] a 64-bit signature for each table: the words at the sampled places of its walk."""
    odd, places = _plan(least)
    out = np.empty((len(windows), REPEATS), np.uint64)
    salt = mix(np.arange(1, REPEATS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(least))
    for a in range(0, len(windows), WINDOWS):
        some = windows[a : a + WINDOWS]
        rows, at = np.arange(len(some))[:, None], np.zeros((len(some), REPEATS), np.int64)
        seen = np.zeros((PLACES, len(some), REPEATS), np.uint64)
        for t in range(len(odd)):
            word = some[rows, at]
            for p in range(PLACES):
                take = places[:, p] == t
                seen[p][:, take] = word[:, take]
            at += (word * odd[t] >> np.uint64(63)).astype(np.int64)
        key = np.broadcast_to(salt, seen[0].shape)
        for p in range(PLACES):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + seen[p])
        out[a : a + WINDOWS] = key
    return out


def repeated(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), first[1], ..."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


@dataclass
class Benchmark:
    """Items as word hashes, the gate's pieces of their parts, and for each class of parts the tables of their signatures."""

    ids: list[int]
    words: np.ndarray  # of all items
    starts: np.ndarray
    sizes: np.ndarray
    edits: np.ndarray
    part_item: np.ndarray
    part_at: np.ndarray  # a part's first word in its item
    part_class: np.ndarray
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # size: field, sorted grams, first, parts, offsets
    tables: dict[int, tuple[np.ndarray, np.ndarray]]  # class: sorted signatures, parts


def edits_of(size: int) -> int:
    return 0 if size < SHORT else int(RATE * size)


def benchmark_of(rows: list[tuple[int | None, str]]) -> Benchmark | None:
    """Of (id, text); items without a word are left out, those without an id are not."""
    hashes = word_hashes(pa.array([t or "" for _, t in rows], pa.string())) if rows else []
    kept = [(i, w) for (i, _), w in zip(rows, hashes, strict=True) if len(w)]
    if not kept:
        return None
    sizes = np.array([len(w) for _, w in kept])
    starts = np.cumsum(sizes) - sizes
    parts = []
    for k, n in enumerate(sizes.tolist()):
        pieces = 1 if n <= MOST_PART else -(-n // PART)
        bounds = [n * p // pieces for p in range(pieces + 1)]
        parts += [(k, a, z - a) for a, z in zip(bounds, bounds[1:], strict=False)]
    part_item, part_at, part_size = (np.array(c) for c in zip(*parts, strict=True))
    part_class = np.array([size_class(n) for n in part_size.tolist()])
    words = np.concatenate([w for _, w in kept])
    part_begin = starts[part_item] + part_at
    found: dict[int, list] = defaultdict(list)
    for k, (begin, n) in enumerate(zip(part_begin.tolist(), part_size.tolist(), strict=True)):
        # a part of a long item may have as many edits for its size, even if short
        pieces = (edits_of(n) if sizes[part_item[k]] <= MOST_PART else int(RATE * n)) + 1
        bounds = [n * p // pieces for p in range(pieces + 1)]
        g = min(GRAM, n // pieces)
        for a in bounds[:-1]:
            found[g].append((int(shingles(words[begin + a : begin + a + g], g)[0]), k, a))
    grams = {}
    for g, rows_g in found.items():
        rows_g.sort()
        key = np.array([r[0] for r in rows_g], np.uint64)
        uniq, first = np.unique(key, return_index=True)
        field = np.zeros(1 << FIELD_BITS, bool)
        field[uniq >> np.uint64(64 - FIELD_BITS)] = True
        grams[g] = (field, uniq, np.append(first, len(key)), np.array([r[1] for r in rows_g]), np.array([r[2] for r in rows_g]))
    tables = {}
    for least in np.unique(part_class).tolist():
        own = np.flatnonzero(part_class == least)
        sign = signatures(cut(words, part_begin[own], part_begin[own], part_begin[own] + part_size[own], steps_of(least)), least).ravel()
        order = np.argsort(sign, kind="stable")
        tables[least] = sign[order], np.repeat(own, REPEATS)[order]
    return Benchmark([i for i, _ in kept], words, starts, sizes, np.array([edits_of(n) for n in sizes.tolist()]), part_item, part_at, part_class, grams, tables)


def gated(words: np.ndarray, b: Benchmark) -> np.ndarray:
    """(class, begin) of windows that have a piece of some part of the class where that part has it, each once."""
    out = []
    for g, (field, uniq, first, parts, offsets) in b.grams.items():
        h = shingles(words, g)
        at = np.flatnonzero(field[h >> np.uint64(64 - FIELD_BITS)])
        if not len(at):
            continue
        k = np.minimum(np.searchsorted(uniq, h[at]), len(uniq) - 1)
        same = uniq[k] == h[at]
        at, k = at[same], k[same]
        n = first[k + 1] - first[k]
        ref = repeated(first[k], n)
        out.append(np.stack([b.part_class[parts[ref]], np.repeat(at, n) - offsets[ref]], 1))
    return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)


def candidates(texts: list[np.ndarray], b: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, begin of the item) that share a bucket of some table, each once; begins within the item's edits are one."""
    windows = [gated(w, b) for w in texts]
    lead = np.concatenate([[0], np.cumsum([len(w) for w in texts])])
    words = np.concatenate(texts) if texts else np.empty(0, np.uint64)
    own = np.repeat(np.arange(len(texts)), [len(w) for w in windows])
    kind, begin = np.concatenate(windows).T if len(own) else (own, own)
    got = []
    for least, (sign, parts) in b.tables.items():
        at = np.flatnonzero(kind == least)
        for some in (at[i : i + WINDOWS] for i in range(0, len(at), WINDOWS)):
            t = own[some]
            asked = signatures(cut(words, begin[some] + lead[t], lead[t], lead[t + 1], steps_of(least)), least).ravel()
            low, high = np.searchsorted(sign, asked, "left"), np.searchsorted(sign, asked, "right")
            n = high - low
            part = parts[repeated(low, n)]
            row = np.repeat(np.repeat(some, REPEATS), n)
            item = b.part_item[part]
            near = np.maximum(b.edits[item], 1)
            got.append(np.unique(np.stack([own[row], item, (begin[row] - b.part_at[part]) // near], 1), axis=0))
    if not got:
        return own, own, own
    text, item, at = np.unique(np.concatenate(got), axis=0).T
    return text, item, at * np.maximum(b.edits[item], 1)


# ---- exact check ----


def enough_shared(item: np.ndarray, size: np.ndarray, region: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Whether all but `edits` of an item's words stand in its region at all: fewer cannot be within that many edits."""
    salt = mix(np.arange(1, len(item) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    there = np.isin(item ^ salt, region ^ salt) & (np.arange(item.shape[1]) < size[:, None])
    return there.sum(1) >= size - edits


def best_stretch(item: np.ndarray, size: np.ndarray, region: np.ndarray, fixed: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each item to a stretch of its region, and the last such stretch's end; it begins anywhere, or at 0 if fixed.

    Rows are zero-padded; zeros of a region equal nothing.
    """
    n, width = region.shape
    cols = np.arange(width + 1)
    row = np.tile(cols if fixed else np.zeros(width + 1, np.int64), (n, 1))
    last = row.copy()
    for i in range(item.shape[1]):
        diag = row[:, :-1] + (region != item[:, i : i + 1])
        here = row + 1
        here[:, 1:] = np.minimum(here[:, 1:], diag)
        row = np.minimum.accumulate(here - cols, axis=1) + cols
        last = np.where((size == i + 1)[:, None], row, last)
    end = last.argmin(1)
    return last[np.arange(n), end], end


def leaks(texts: list[np.ndarray], b: Benchmark) -> list[tuple[int, int, int, int, int]]:
    """(text, item, begin, end, edits) of the nearest stretch, in words, of each item that leaks into each text."""
    own, item_of, begin_of = candidates(texts, b)
    lead = np.concatenate([[0], np.cumsum([len(w) for w in texts])])
    words = np.concatenate(texts) if texts else np.empty(0, np.uint64)
    order = np.argsort(b.sizes[item_of], kind="stable")
    own, item_of, begin_of = own[order], item_of[order], begin_of[order]
    reach = (b.sizes + 3 * b.edits + 1)[item_of]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    start = 0
    while start < len(own):
        # windows of like sizes, the widest of them last: as many as the cells hold
        some = reach[start : start + CELLS]
        after_last = start + max(1, int(np.searchsorted(some * np.arange(1, len(some) + 1), CELLS, "right")))
        text, item, begin = own[start:after_last], item_of[start:after_last], begin_of[start:after_last]
        start = after_last
        size, first, after, slack = b.sizes[item], lead[text], lead[text + 1], b.edits[item]
        low = np.clip(begin + first - slack, first, after)
        high = np.clip(begin + first + size + 2 * slack, low, after)
        mine = cut(b.words, b.starts[item], b.starts[item], b.starts[item] + size, int(size.max()))
        near = enough_shared(mine, size, cut(words, low, low, high, max(1, int((high - low).max()))), slack)
        if not near.any():
            continue
        text, item, size, first, slack, low, high, mine = (x[near] for x in (text, item, size, first, slack, low, high, mine))
        mine = mine[:, : int(size.max())]
        edits, end = best_stretch(mine, size, cut(words, low, low, high, max(1, int((high - low).max()))))
        ok = edits <= slack
        if not ok.any():
            continue
        text, item, size, low, end, edits, mine, first = (x[ok] for x in (text, item, size, low, end, edits, mine, first))
        place = np.arange(mine.shape[1])
        turned = np.where(place < size[:, None], np.take_along_axis(mine, np.clip(size[:, None] - 1 - place, 0, None), 1), np.uint64(0))
        back = len(words) - (low + end)
        _, length = best_stretch(turned, size, cut(words[::-1], back, back, back + end, max(1, int(end.max()))), fixed=True)
        for t, k, e, z, n in zip(text.tolist(), item.tolist(), edits.tolist(), (low + end - first).tolist(), length.tolist(), strict=True):
            got = (e, z - n, z)
            best[t, k] = min(best.get((t, k), got), got)
    return [(t, k, a, z, e) for (t, k), (e, a, z) in sorted(best.items())]


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Benchmark]:
    """The benchmark, a stated query set, in blocks of BLOCK_ITEMS items that come to the driver one after another."""
    block = []
    for r in benchmark.select(F.col(item_col).cast("long"), text_col).toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == BLOCK_ITEMS:
            if b := benchmark_of(block):
                yield b
            block = []
    if b := benchmark_of(block):
        yield b


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, word_begin, word_end, edits: the nearest stretch of each document for each item that leaks into it.

    Each block of items is searched in one pass over the whole texts, without a shuffle. A row repeated in `docs` is reported
    again and a null id is passed on; rows without a leak, null or empty texts and items give nothing. Of items that share an
    id each is searched; one without an id is too, and reported with a null item_id. An empty table on either side gives an empty one.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, word_begin long, word_end long, edits long"

    def search(b: Benchmark) -> DataFrame:
        sent = spark.sparkContext.broadcast(b)

        def run(batches) -> Iterator[pa.RecordBatch]:
            working("decontaminate")
            own = sent.value
            for batch in batches:
                for row, texts in text_runs(batch, 1):
                    ids = batch.column(0).slice(row, len(texts))
                    got = [(ids[t].as_py(), own.ids[k], a, z, e) for t, k, a, z, e in leaks(word_hashes(texts), own)]
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], names=["doc_id", "item_id", "word_begin", "word_end", "edits"])

        return rows.mapInArrow(run, schema)

    out = None
    for b in blocks_of(benchmark, item_col, item_text_col):
        out = search(b) if out is None else out.union(search(b))
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, into whose text no item leaks; a row goes in the pass that finds it, without a join.

    Null and empty texts stay, whatever their id; without an item all rows stay.
    """
    spark = prepare(docs.sparkSession)
    at = docs.columns.index(text_col)
    out = docs
    for b in blocks_of(benchmark, item_col, item_text_col):
        sent = spark.sparkContext.broadcast(b)

        def run(batches, sent=sent) -> Iterator[pa.RecordBatch]:
            working("decontaminate")
            own = sent.value
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for row, texts in text_runs(batch, at):
                    clean[[row + t for t, *_ in leaks(word_hashes(texts), own)]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
