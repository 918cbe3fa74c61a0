"""Removal of repeated passages: a compressed FM-index per shard answers which windows of words occur more than once.

A window's shard is that of its minimizer, the least hash of the short word runs in it, so equal windows meet in one shard.
Consecutive windows with one minimizer travel as one segment. Segments whose minimizer is theirs alone are done; equal ones
are counted before they move, and stand in the index as one row of their class. What is left is indexed shard by shard: a
wavelet matrix of compressed bitmaps over the Burrows-Wheeler transform, with suffixes sorted as deep as a search goes. The
documents' stretches are streamed through it by backward search, which gives their matching statistics: how far left of a
place a stretch occurs twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._common import by_group, hash_words, mix, prepare, split_words, text_runs, work_table, working

#: Words of the runs that minimizers are chosen from; words a search matches at most, for windows of up to half as many.
GRAM, DEPTH = 8, 64
#: Words of an index; segments of one minimizer beyond which each window travels alone, to a shard of its own hash.
SHARD_WORDS, HOT_SEGMENTS = 2_000_000, 20_000
#: Segments of a bucket in which they meet; digests that a task keeps to cut equal texts once.
BUCKET_SEGMENTS, HELD_DIGESTS = 2_000_000, 200_000


def depth_of(window: int) -> int:
    """Words that suffixes are sorted by and segments have at most: a power of two that leaves room for several windows."""
    depth = DEPTH
    while depth < window + window // 2:
        depth *= 2
    return depth


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    n = len(v) - w + 1
    pad = np.concatenate([v, np.full(-len(v) % w, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, w)
    left = np.minimum.accumulate(pad, axis=1).ravel()
    right = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse in the ring
_POWERS: list[np.ndarray] = []


class Rolling:
    """64-bit hashes of any stretches of a sequence: a polynomial over the 64-bit ring, mixed with the stretch's size."""

    def __init__(self, h: np.ndarray):
        self.n = len(h)
        if not _POWERS or len(_POWERS[0]) <= self.n:
            size = max(2 * self.n, 1 << 16)
            _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size, b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        self.total = np.zeros(self.n + 1, np.uint64)
        np.add.accumulate(h * _POWERS[0][: self.n], out=self.total[1:])

    def of(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix((self.total[start + size] - self.total[start]) * _POWERS[1][start] + size.astype(np.uint64))

    def each(self, size: int) -> np.ndarray:
        """Of all stretches of one size."""
        n = self.n - size + 1
        return mix((self.total[size:] - self.total[:n]) * _POWERS[1][:n])


def segments(roll: Rolling, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, windows) of each run of windows with one minimizer; a run is cut to what a search can match."""
    if roll.n < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    gram = min(GRAM, window)
    least = sliding_min(roll.each(gram), window - gram + 1)
    first = np.flatnonzero(np.diff(least, prepend=~least[:1]))
    count = np.diff(np.append(first, len(least)))
    most = depth_of(window) - window + 1
    pieces = -(-count // most)
    inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(first, pieces) + inner * most
    size = np.minimum(most, np.repeat(first + count, pieces) - start)
    return (np.repeat(least[first], pieces) >> np.uint64(1)).astype(np.int64), start, size


# ---- FM-index ----


class Bits:
    """A bitmap without its words that are all zeros or all ones, of which a transform of repeated text has many.

    Ones before each 64-bit word and stored words before it are 16-bit counts within blocks of BLOCK words and 64-bit counts
    before each block; a word whose ones are 0 or 64 is not stored.
    """

    BLOCK = 512

    def __init__(self, bits: np.ndarray):
        words = np.packbits(np.concatenate([bits, np.zeros(64 + -len(bits) % 64, bool)]), bitorder="little").view(np.uint64)
        ones = np.bitwise_count(words).astype(np.int64)
        mixed = (ones > 0) & (ones < 64)
        self.words = words[mixed] if mixed.any() else np.zeros(1, np.uint64)
        self.ones, self.ones_in = self._directory(ones)
        self.stored, self.stored_in = self._directory(mixed.astype(np.int64))

    def _directory(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before = np.concatenate([[0], np.cumsum(counts)])
        block = before[:: self.BLOCK]
        return block, (before - np.repeat(block, self.BLOCK)[: len(before)]).astype(np.uint16)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, off = at >> 6, at & 63
        block = word // self.BLOCK
        before = self.ones[block] + self.ones_in[word]
        own = self.ones[(word + 1) // self.BLOCK] + self.ones_in[word + 1] - before
        here = self.words[np.minimum(self.stored[block] + self.stored_in[word], len(self.words) - 1)]
        part = np.bitwise_count(here & ((np.uint64(1) << off.astype(np.uint64)) - np.uint64(1)))
        return before + np.where(own == 0, 0, np.where(own == 64, off, part))


class WaveletMatrix:
    """Rank of any symbol: one bitmap a bit, most significant first, zeros before ones from level to level."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.n = bits, len(values)
        self.levels = []
        for b in range(bits - 1, -1, -1):
            one = (values >> b & 1).astype(bool)
            self.levels.append((Bits(one), int(len(one) - one.sum())))
            values = np.concatenate([values[~one], values[one]])

    def rank(self, symbol: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each of its places ([k, n]), less those before place 0."""
        at = np.concatenate([np.zeros((1, len(symbol)), np.int64), places])
        for k, (bits, zeros) in enumerate(self.levels):
            ones = bits.rank(at)
            bit = symbol >> (self.bits - 1 - k) & 1
            at = np.where(bit == 1, zeros + ones, at - ones)
        return at[1:] - at[0]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` symbols (a power of two), by doubling."""
    n = len(text)
    rank = text.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    size = 1
    while True:
        if size > 1 or depth == 1:
            order = np.argsort(key, kind="stable")
        else:
            key = rank
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(sorted_key, prepend=sorted_key[:1]) != 0)
        if size >= depth or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: n - size] = rank[size:] + 1
        key = rank * (n + 1) + after
        size *= 2


class FmIndex:
    """Of a text of symbols 0 (a separator) and up; patterns of up to `depth` symbols without a separator. The text is not kept."""

    def __init__(self, text: np.ndarray, depth: int = DEPTH):
        symbols = int(text.max()) + 1
        order = suffix_order(text, depth)
        self.wavelet = WaveletMatrix(text[order - 1], max(1, (symbols - 1).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with the symbol and go on as those of the ranges."""
        a, b = self.wavelet.rank(symbol, np.stack([low, high]))
        return self.before[symbol] + a, self.before[symbol] + b

    def longest(self, stream: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each stretch of a stream of symbols, how far left of `end` (not beyond `begin`) it occurs twice: the place reached."""
        at = end - 1
        first = stream[at]
        low, high = self.before[first], self.before[first + 1]
        reached = np.where(high - low >= 2, at, end)
        live = np.flatnonzero((high - low >= 2) & (at > begin))
        low, high = low[live], high[live]
        while len(live):
            symbol = stream[reached[live] - 1]
            low, high = self.extend(symbol, low, high)
            more = high - low >= 2
            live, low, high = live[more], low[more], high[more]
            reached[live] -= 1
            more = reached[live] > begin[live]
            live, low, high = live[more], low[more], high[more]
        return reached


def repeated_windows(index: FmIndex, stream: np.ndarray, begin: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
    """For each stretch of `windows` windows from `begin`, a row of flags [stretch, most windows]: the window occurs again.

    One search of a whole stretch from its end settles those that occur again whole. Else windows are searched from the left:
    a search that stops short of a window's begin settles all windows up to where it stopped.
    """
    out = np.zeros((len(begin), int(windows.max(initial=1))), bool)
    place = np.arange(out.shape[1])
    got = index.longest(stream, begin, begin + windows + window - 1) - begin
    out |= (place >= got[:, None]) & (place < windows[:, None])
    # windows from `got` on are settled, the one that ends the stretch too
    left = np.minimum(got, windows - 1)
    now = np.zeros(len(begin), np.int64)
    live = np.flatnonzero(now < left)
    while len(live):
        s = begin[live] + now[live]
        got = index.longest(stream, s, s + window) - s
        hit = got == 0
        out[live[hit], now[live[hit]]] = True
        now[live] += np.maximum(got, 1)
        live = live[now[live] < left[live]]
    return out


# ---- the job ----


def _digests(texts: pa.Array) -> Iterator[tuple[np.ndarray, bytes, str]]:
    """Of each text the words' hashes, their digest, and the words joined by a space."""
    words, sizes = split_words(texts)
    h, ends = hash_words(words), np.concatenate([[0], np.cumsum(sizes)])
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words), " ").to_pylist()
    for a, z, text in zip(ends.tolist(), ends[1:].tolist(), joined, strict=False):
        yield h[a:z], xxhash.xxh3_128_digest(h[a:z].tobytes()), text or ""


def _read(rows: DataFrame, window: int) -> DataFrame:
    """Each text's size and digests, and its segments unless the task has met the same words: m, s (digest), first, windows, own.

    `own` says that a segment has one window twice.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        working("repeats")
        seen: set = set()
        for batch in batches:
            for row, texts in text_runs(batch, 2):
                out = []
                for h, digest, joined in _digests(texts):
                    blob = None
                    if len(h) >= window and digest not in seen:
                        if len(seen) >= HELD_DIGESTS:
                            seen.clear()
                        seen.add(digest)
                        roll = Rolling(h)
                        m, first, count = segments(roll, window)
                        each = roll.each(window)
                        own = np.zeros(len(m), np.uint8)
                        ordered = np.sort(each)
                        if (ordered[1:] == ordered[:-1]).any():
                            part = np.repeat(np.arange(len(m)), count)
                            order = np.lexsort((each, part))
                            twice = (np.diff(part[order]) == 0) & (each[order][1:] == each[order][:-1])
                            own[part[order][1:][twice]] = 1
                        s = roll.of(first, count + window - 1)
                        blob = b"".join([m.astype("<i8").tobytes(), s.astype("<u8").tobytes(), first.astype("<i4").tobytes(), count.astype("<i2").tobytes(), own.tobytes()])
                    out.append((len(h), digest, hashlib.sha256(joined.encode("utf-8")).digest(), blob))
                n, digest, sha, blob = zip(*out, strict=True)
                some = batch.slice(row, len(out))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sha, pa.binary()), pa.array(blob, pa.binary())], names=["doc_id", "content", "n_words", "digest", "sha", "segs"])

    return rows.select("doc_id", "content", "text").mapInArrow(run, "doc_id long, content long, n_words long, digest binary, sha binary, segs binary")


_FIELDS = (("m", "<i8"), ("s", "<i8"), ("doc", "<i8"), ("first", "<i4"), ("count", "<i2"), ("own", "u1"), ("times", "<i4"))
SEGMENT_BYTES = 23
FULL, ASK, TEXT, ALONE = 0, 1, 2, 4


def _flat(doc, first, count, kind) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(doc), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000], t) for x, t in ((doc, pa.int64()), (first, pa.int32()), (count, pa.int32()), (kind, pa.int32()))], names=["cls", "first", "windows", "kind"])


def _judge(classes: DataFrame, buckets: int) -> DataFrame:
    """(cls, first, windows, kind) of segments that occur again whole (FULL) or that an index has to settle.

    Segments meet by minimizer. A task sends equal segments once, with their number, so what all documents share arrives as
    one row a task; kind ASK is to be searched, TEXT only to be in the index, ALONE added where the minimizer is a hot one.
    """

    def deal(batches) -> Iterator[pa.RecordBatch]:
        working("repeats")
        held, n, seq = [], 0, 0

        def blocks() -> pa.RecordBatch:
            nonlocal seq
            col = {k: np.concatenate([h[k] for h in held]) for k, _ in _FIELDS[:6]}
            bucket = (mix(col["m"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((col["s"], col["m"], bucket))
            col, bucket = {k: v[order] for k, v in col.items()}, bucket[order]
            new = (np.diff(col["m"], prepend=-1) != 0) | (np.diff(col["s"], prepend=~col["s"][:1]) != 0)
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(new)))
            again = np.repeat(times > 1, times)
            sent = {k: v[first] for k, v in col.items()} | {"times": times}
            bounds = np.searchsorted(bucket[first], np.arange(buckets + 1))
            rows = [(b, 0, {k: v[x:y] for k, v in sent.items()}) for b, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)) if x < y]
            known = {k: v[again] for k, v in col.items()} | {"times": np.repeat(times, times)[again]}
            for i in range(0, len(known["m"]), 100_000):
                seq += 1
                rows.append((seq % buckets, 1, {k: v[i : i + 100_000] for k, v in known.items()}))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *(pa.array([r[k].astype(t).tobytes() for *_, r in rows], pa.binary()) for k, t in _FIELDS)], names=["b", "told", *(k for k, _ in _FIELDS)])

        for batch in batches:
            for doc, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = len(blob) // SEGMENT_BYTES
                cuts = np.cumsum([0, 8, 8, 4, 2, 1]) * size
                m, s, first, count, own = (np.frombuffer(blob[a:b], t) for a, b, t in zip(cuts, cuts[1:], ("<i8", "<i8", "<i4", "<i2", "u1"), strict=False))
                held.append({"m": m, "s": s, "doc": np.full(size, doc), "first": first, "count": count, "own": own})
                n += size
                if n >= 1_000_000:
                    yield blocks()
                    held, n = [], 0
        if n:
            yield blocks()

    def meet(batches) -> Iterator[pa.RecordBatch]:
        working("repeats")
        held: dict[int, list] = {}
        for batch in batches:
            for b, told, *raw in zip(*(batch.column(i).to_pylist() for i in range(2 + len(_FIELDS))), strict=True):
                col = {k: np.frombuffer(r, t) for (k, t), r in zip(_FIELDS, raw, strict=True)}
                if told:
                    yield from _flat(col["doc"], col["first"], col["count"].astype(np.int32), np.full(len(col["m"]), FULL, np.int32))
                else:
                    held.setdefault(b, []).append(col)
        for b in sorted(held):
            parts = held.pop(b)
            col = {k: np.concatenate([p[k] for p in parts]) for k, _ in _FIELDS}
            order = np.lexsort((col["s"], col["m"]))
            col = {k: v[order] for k, v in col.items()}
            new_m = np.diff(col["m"], prepend=-1) != 0
            new = new_m | (np.diff(col["s"], prepend=~col["s"][:1]) != 0)
            first = np.flatnonzero(new)
            rows = np.diff(np.append(first, len(new)))
            times = np.add.reduceat(col["times"].astype(np.int64), first) if len(first) else rows
            group = np.cumsum(new_m[first]) - 1
            kinds = np.bincount(group, minlength=1)[group] if len(first) else group
            # copies that met here; those that met in their task are told above
            full = np.repeat(times > 1, rows) & (col["times"] == 1)
            yield from _flat(col["doc"][full], col["first"][full], col["count"][full].astype(np.int32), np.full(int(full.sum()), FULL, np.int32))
            ask = (kinds > 1) | (col["own"][first] > 0)
            at, kind = first[ask], np.where(times[ask] > 1, TEXT, ASK) + np.where(kinds[ask] > HOT_SEGMENTS, ALONE, 0)
            yield from _flat(col["doc"][at], col["first"][at], col["count"][at].astype(np.int32), kind.astype(np.int32))

    dealt = classes.select("cls", "segs").mapInArrow(deal, "b int, told int, " + ", ".join(f"{k} binary" for k, _ in _FIELDS))
    return dealt.repartitionById(buckets, F.col("b")).mapInArrow(meet, "cls long, first int, windows int, kind int")


def _indexed(texts: DataFrame, buckets: int, window: int) -> DataFrame:
    """(cls, first, windows) of runs of windows that occur again, of (cls, digest, text, asked: array of first, windows, kind)."""

    def cut(batches) -> Iterator[pa.RecordBatch]:
        working("repeats")
        for batch in batches:
            for row, some in text_runs(batch, 2):
                out, rest = [], batch.slice(row, len(some))
                for (h, own, joined), cls, digest, asked in zip(_digests(some), *(rest.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                    if own != digest:  # another text of the same id and 64-bit hash
                        continue
                    words, roll = joined.split(" "), Rolling(h)
                    m, first, _ = segments(roll, window)
                    key = dict(zip(first.tolist(), m.tolist(), strict=True))
                    for a in asked:
                        if a["kind"] & ALONE:
                            starts = np.arange(a["first"], a["first"] + a["windows"])
                            for s, x in zip(starts.tolist(), roll.of(starts, np.full(len(starts), window)).tolist(), strict=True):
                                out.append((x >> 1, cls, s, 1, a["kind"] & ASK, " ".join(words[s : s + window])))
                        else:
                            out.append((key[a["first"]], cls, a["first"], a["windows"], a["kind"] & ASK, " ".join(words[a["first"] : a["first"] + a["windows"] + window - 1])))
                    if len(out) > 20_000:
                        yield _batch(out)
                        out = []
                if out:
                    yield _batch(out)

    def _batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["key", "cls", "first", "windows", "ask", "words"])

    def search(batches) -> Iterator[pa.RecordBatch]:
        working("repeats")
        held, size, last = [], 0, None

        def close() -> Iterator[pa.RecordBatch]:
            asked = np.array([r[3] for r in held], bool)
            if not asked.any():
                return
            lists = pc.split_pattern(pa.array([r[4] for r in held], pa.string()), " ")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            text = np.zeros(len(codes) + len(lists), np.int64)
            begin = np.cumsum(sizes + 1) - sizes - 1
            inner = np.ones(len(text), bool)
            inner[begin + sizes] = False
            text[inner] = codes.astype(np.int64) + 1
            index = FmIndex(text, depth_of(window))
            stream = text.astype(np.int32)
            which = np.flatnonzero(asked)
            count = np.array([r[2] for r in held])[which]
            for i in range(0, len(which), 100_000):
                part, n = which[i : i + 100_000], count[i : i + 100_000]
                flags = repeated_windows(index, stream, begin[part], n, window)
                edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
                row, a = np.nonzero(edge == 1)
                _, z = np.nonzero(edge == -1)
                if len(row):
                    cls, first = np.array([held[k][0] for k in part[row]], np.int64), np.array([held[k][1] for k in part[row]], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array((first + a).astype(np.int32)), pa.array((z - a).astype(np.int32))], names=["cls", "first", "windows"])

        for batch in batches:
            for key, *row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if key != last and size >= SHARD_WORDS:
                    yield from close()
                    held, size = [], 0
                last = key
                held.append(row)
                size += row[2] + window
        if held:
            yield from close()

    cutting = texts.select("cls", "digest", "text", "asked").mapInArrow(cut, "key long, cls long, first int, windows int, ask int, words string")
    return cutting.repartition(buckets, "key").sortWithinPartitions("key").mapInArrow(search, "cls long, first int, windows int")


def _kept(texts: DataFrame, window: int, digest: bool) -> DataFrame:
    """Of (key, own, text, runs, whole): key, own, words, words removed (all if whole) and what is left, or its SHA-256."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        working("repeats")
        for batch in batches:
            for row, some in text_runs(batch, 2):
                rest, out = batch.slice(row, len(some)), []
                for (h, own, joined), runs, whole in zip(_digests(some), *(rest.column(i).to_pylist() for i in (3, 4)), strict=True):
                    n = len(h)
                    edge = np.zeros(n + 1, np.int64)
                    for r in runs or ():
                        edge[min(r["first"], n)] += 1
                        edge[min(r["first"] + r["windows"] + window - 1, n)] -= 1
                    gone = np.ones(n, bool) if whole else np.cumsum(edge)[:-1] > 0
                    kept = " ".join(w for w, g in zip(joined.split(" "), gone.tolist(), strict=False) if not g) if n else ""
                    out.append((own, n, int(gone.sum()), hashlib.sha256(kept.encode("utf-8")).hexdigest() if digest else kept))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([rest.column(0), rest.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "wanted", "digest", "n_words", "n_removed", "kept"])

    return texts.select("doc_id", "wanted", "text", "runs", "whole").mapInArrow(run, "doc_id long, wanted binary, digest binary, n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept: each text without the words of windows that occur elsewhere too, this text included.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged; kept is the words left, joined by a space, or with `digest` their SHA-256.
    A text whose words equal another's loses all of them if there are `window` or more, without a search. A null text has no
    words. Texts, not ids, are what is compared: rows that repeat an id are judged each by its own text, and rows with a null
    id count for others and are searched as any row is. Other columns are not read; an empty table gives an empty one.
    """
    if window < 1:
        raise ValueError("window must be a word or more")
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("content", F.xxhash64("text"))
    table = work_table(spark, _read(rows, window), "repeats-read")
    total, long = table.count(), F.col("n_words") >= window
    # a class of equal word sequences has its own number; its text is read again from one row, named by id and content
    one_row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("own_id"), F.col("content").alias("own_content"))).alias("row")
    classes = table.where(long).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.max("segs").alias("segs"), one_row)
    classes = work_table(spark, classes.select(F.monotonically_increasing_id().alias("cls"), "digest", "copies", "segs", "row.own_id", "row.own_content"), "repeats-classes")
    n_segments = (classes.agg(F.sum(F.length("segs"))).first()[0] or 0) // SEGMENT_BYTES
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_segments // BUCKET_SEGMENTS))
    judged = work_table(spark, _judge(classes, buckets), "repeats-judged")
    named = classes.select("cls", "digest", "copies", "own_id", "own_content")
    same_row = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("content") == F.col("own_content"))
    asked = judged.where(f"kind <> {FULL}").groupBy("cls").agg(F.collect_list(F.struct("first", "windows", "kind")).alias("asked"))
    found = _indexed(rows.join(asked.join(named, "cls").hint("merge"), same_row), buckets, window)
    runs = judged.where(f"kind = {FULL}").select("cls", "first", "windows").union(found).groupBy("cls").agg(F.collect_list(F.struct("first", "windows")).alias("runs"))
    # texts with a copy lose all words, whatever their runs are
    runs = runs.join(named.where("copies = 1"), "cls").select("digest", "runs", "own_id", "own_content")
    copies = named.where("copies > 1").select("digest", "copies")
    if not digest:
        told = by_group(table.select("doc_id", "content", "digest", "n_words"), copies, ["digest"], "copies", total, "left")
        alone = F.col("copies").isNull() & long
        told = told.where(alone).join(runs.select("digest", "runs"), "digest", "left").unionByName(told.where(~alone), allowMissingColumns=True)
        told = told.select(F.col("doc_id").alias("own_id"), F.col("content").alias("own_content"), F.col("digest").alias("wanted"), "runs", F.col("copies").isNotNull().alias("whole"))
        told = told.dropDuplicates(["own_id", "own_content", "wanted"])
        return _kept(rows.join(told.hint("merge"), same_row), window, False).where("wanted = digest").select("doc_id", "n_words", "n_removed", "kept")
    cut = _kept(rows.join(runs.withColumnRenamed("digest", "wanted").hint("merge"), same_row).withColumn("whole", F.lit(False)), window, True)
    cut = cut.where("wanted = digest").select("digest", F.col("n_removed").alias("cut"), "kept")
    base = by_group(table.select("doc_id", "n_words", "digest", "sha"), copies, ["digest"], "copies", total, "left")
    none, sha = F.lit(hashlib.sha256(b"").hexdigest()), F.lower(F.hex("sha"))
    whole = base.where(F.col("copies").isNotNull()).select("doc_id", "n_words", F.col("n_words").alias("n_removed"), none.alias("kept"))
    short = table.where(~long).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), sha.alias("kept"))
    single = base.where(F.col("copies").isNull() & long).join(cut.hint("merge"), "digest", "left")
    single = single.select("doc_id", "n_words", F.coalesce("cut", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", sha).alias("kept"))
    return whole.union(single).union(short)
