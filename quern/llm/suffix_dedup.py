"""Removal of byte strings that documents with smaller ids have too, by prefix doubling dealt out by anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._common import bucketed_table, drop_table, mix, prepare, work_table

#: Bytes of a unit of documents (one document at least), of a partition of units, and of text whose keys make one bucket.
UNIT_BYTES, PART_BYTES, BUCKET_BYTES = 4_000_000, 32_000_000, 16_000_000
#: Bytes looked at together.
SLICE = 1 << 18
#: Keys that more units than this share are dealt out window by window.
HOT_UNITS = 1_000
NO_ID = np.iinfo(np.int64).max
_ODDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D)]


def _words(length: int) -> list[int]:
    """Where 8-byte words start that cover `length` bytes."""
    return sorted({*range(0, length - 7, 8), length - 8})


def _hashed(view: np.ndarray, at, length: int, turn: int = 0) -> np.ndarray:
    """A 64-bit hash of the `length` bytes at each place (a slice or places) of a view of words."""
    take = (lambda o: view[at.start + o : at.stop + o]) if isinstance(at, slice) else (lambda o: view[at + o])
    out = None
    for k, o in enumerate(_words(length)):
        part = take(o) * _ODDS[(k + turn) % len(_ODDS)]
        if out is None:
            out = part
        else:
            out ^= out >> np.uint64(31)
            out += part
    return mix(out)


def word_view(raw: np.ndarray) -> np.ndarray:
    """The 8-byte word at every place of bytes that end in 8 spare ones, without a copy."""
    return np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, one after another."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class Unit:
    """Some documents' bytes, their windows, and the anchor of each window: its `gram` bytes of the smallest hash, the leftmost of equal ones.

    The anchor depends on the window's bytes alone, so equal windows have equal anchors at equal places. A segment is a run of
    windows of one document with the same anchor; its bytes have up to 2 * window - gram of them.
    """

    def __init__(self, row: dict, window: int):
        self.window, self.gram = window, window * 2 // 5
        self.raw = np.frombuffer(row["blob"] + bytes(window + 8), np.uint8)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.n = len(row["blob"])
        self.view = word_view(self.raw)
        self._segments()
        self.doc = np.searchsorted(self.ends, self.lo, "right")
        self.key = _hashed(self.view, self.anchor, self.gram, 3)

    def _segments(self) -> None:
        late = np.minimum(self.sizes, self.window - 1)
        fits = np.repeat(np.tile([True, False], len(self.sizes)), np.c_[self.sizes - late, late].ravel())
        spread, low, high, anchors = self.window - self.gram + 1, [], [], []
        for s in range(0, self.n, SLICE):
            e = min(s + SLICE, self.n)
            m = _hashed(self.view, slice(s, min(e + spread - 1, self.n)), self.gram)
            m = np.r_[(m & ~np.uint64(0xFFFFFF)) | np.arange(len(m), dtype=np.uint64), np.full(e + spread - 1 - s - len(m), ~np.uint64(0))]
            have = 1
            while have < spread:
                step = min(have, spread - have)
                m = np.minimum(m[:-step], m[step:])
                have += step
            a, ok = (m & np.uint64(0xFFFFFF)).astype(np.int64) + s, fits[s:e]
            edge = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (ok[1:] != ok[:-1])])
            last = np.r_[edge[1:], e - s] - 1
            good = ok[edge]
            low.append(edge[good] + s)
            high.append(last[good] + s)
            anchors.append(a[edge[good]])
        cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        self.lo, self.hi, self.anchor = cat(low), cat(high), cat(anchors)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, which of them documents of several ids have, and each segment's place among them."""
        key, place = np.unique(self.key, return_inverse=True)
        order = np.argsort(place, kind="stable")
        head = np.searchsorted(place[order], np.arange(len(key)))
        ids = self.ids[self.doc[order]]
        if not len(key):
            return key, np.empty(0, bool), place
        return key, np.minimum.reduceat(ids, head) != np.maximum.reduceat(ids, head), place

    def shared(self, answer: list[dict]) -> None:
        """Keep the segments whose key others have; those of very common keys fall into single windows, each a key of its own."""
        _, _, place = self.keys()
        n = int(place.max()) + 1 if len(place) else 0
        alive, hot = (np.concatenate([np.unpackbits(np.frombuffer(a[c], np.uint8), count=a["n"]) for a in answer]).astype(bool) if answer else np.zeros(n, bool) for c in ("alive", "hot"))
        single, rest = alive[place] & hot[place], alive[place] & ~hot[place]
        count = (self.hi - self.lo + 1)[single]
        at = ranges(self.lo[single], count)
        self.key = np.r_[self.key[rest], _hashed(self.view, at, self.window, 5)]
        self.doc = np.r_[self.doc[rest], np.repeat(self.doc[single], count)]
        self.lo, self.hi = np.r_[self.lo[rest], at], np.r_[self.hi[rest], at]

    def classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the segments by key and bytes, where each class of equal ones begins in it, and each class's smallest id."""
        content = contents(self.view, self.lo, self.hi, self.window)
        order = np.lexsort((content, self.key))
        k, c = self.key[order], content[order]
        head = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])][: len(k)])
        least = np.minimum.reduceat(self.ids[self.doc[order]], head) if len(head) else np.empty(0, np.int64)
        return order, head, least


def contents(view: np.ndarray, lo: np.ndarray, hi: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of each segment's bytes: its first and last window cover it."""
    return mix(_hashed(view, lo, window, 1) * _ODDS[0] + _hashed(view, hi, window, 2) + (hi - lo).astype(np.uint64))


def _make_units(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId(), 0
    ids, sizes, blobs, held = [], [], [], 0

    def unit():
        one = {"unit": (part << 32) + made, "ids": np.concatenate(ids).tobytes(), "nulls": np.concatenate(nulls).tobytes(), "sizes": np.concatenate(sizes).tobytes(), "blob": b"".join(blobs)}
        return pa.RecordBatch.from_pylist([one], _UNIT)

    nulls: list = []
    for batch in batches:
        texts = batch.column(1).fill_null("")
        off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        raw, at = memoryview(texts.buffers()[2] or b""), 0
        null = np.asarray(batch.column(0).is_null())
        own = batch.column(0).fill_null(NO_ID).to_numpy()
        while at < len(texts):
            to = min(len(texts), max(at + 1, int(np.searchsorted(off, off[at] + most - held, "right")) - 1))
            ids.append(own[at:to])
            nulls.append(null[at:to])
            sizes.append(np.diff(off[at : to + 1]).astype(np.int64))
            blobs.append(bytes(raw[off[at] : off[to]]))
            held, at = held + len(blobs[-1]), to
            if held >= most or at < len(texts):
                yield unit()
                made, held = made + 1, 0
                for x in (ids, nulls, sizes, blobs):
                    x.clear()
    if ids:
        yield unit()


_UNIT = pa.schema([("unit", pa.int64()), ("ids", pa.binary()), ("nulls", pa.binary()), ("sizes", pa.binary()), ("blob", pa.binary())])
_KEYS = pa.schema([("bucket", pa.int64()), ("unit", pa.int64()), ("keys", pa.binary()), ("several", pa.binary())])
_ALIVE = pa.schema([("unit", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("alive", pa.binary()), ("hot", pa.binary())])
_SEGMENTS = pa.schema([("bucket", pa.int64()), ("unit", pa.int64()), ("keys", pa.binary()), ("windows", pa.binary()), ("least", pa.binary()), ("blob", pa.binary())])
_FOUND = pa.schema([("unit", pa.int64()), ("bucket", pa.int64()), ("runs", pa.binary()), ("counts", pa.binary()), ("least", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'long'}" for f in schema)


def _bucket_cuts(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (the top bits) that sorted keys fall into, and where each begins and the last ends."""
    b = (keys >> np.uint64(64 - bits)).astype(np.int64)
    head = np.flatnonzero(np.r_[True, b[1:] != b[:-1]][: len(b)])
    return b[head], np.r_[head, len(b)]


def _ask_keys(batches: Iterator[pa.RecordBatch], window: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            key, several, _ = Unit(row, window).keys()
            buckets, cut = _bucket_cuts(key, bits)
            yield pa.RecordBatch.from_pylist([{"bucket": int(b), "unit": row["unit"], "keys": key[i:j].tobytes(), "several": np.packbits(several[i:j]).tobytes()} for b, i, j in zip(buckets, cut, cut[1:], strict=False)], _KEYS)


def _answer_keys(rows: pa.Table, hot_units: int) -> pa.Table:
    """Which keys of a bucket occur in several documents: in two units, or under several ids in one."""
    rows = rows.to_pylist()
    keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
    several = [np.unpackbits(np.frombuffer(r["several"], np.uint8), count=len(k)).astype(bool) for r, k in zip(rows, keys, strict=True)]
    everything = np.sort(np.concatenate(keys))
    head = np.flatnonzero(np.r_[True, everything[1:] != everything[:-1]])
    count = np.diff(np.r_[head, len(everything)])
    twice, common = everything[head][count > 1], everything[head][count > hot_units]
    within = np.sort(np.concatenate([k[s] for k, s in zip(keys, several, strict=True)]))
    known = np.union1d(twice, within)
    out = []
    for r, k in zip(rows, keys, strict=True):
        alive, hot = (np.packbits(np.isin(k, x, assume_unique=True)).tobytes() for x in (known, common))
        out.append({"unit": r["unit"], "bucket": r["bucket"], "n": len(k), "alive": alive, "hot": hot})
    return pa.Table.from_pylist(out, _ALIVE)


def _ask_segments(batches: Iterator[pa.RecordBatch], window: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            unit = Unit(row, window)
            unit.shared(row["answer"] or [])
            order, head, least = unit.classes()
            if not len(head):
                continue
            first = order[head]
            lo, hi, key = unit.lo[first], unit.hi[first], unit.key[first]
            size = hi - lo + window
            blob, begin = unit.raw[ranges(lo, size)], np.r_[0, np.cumsum(size)]
            buckets, cut = _bucket_cuts(key, bits)
            yield pa.RecordBatch.from_pylist([{"bucket": int(b), "unit": row["unit"], "keys": key[i:j].tobytes(), "windows": (hi - lo + 1)[i:j].astype(np.uint8).tobytes(), "least": least[i:j].tobytes(), "blob": blob[begin[i] : begin[j]].tobytes()} for b, i, j in zip(buckets, cut, cut[1:], strict=False)], _SEGMENTS)


def ranked(values: np.ndarray) -> np.ndarray:
    """The rank of each value in sorted order, -1 for those that occur once."""
    order = np.argsort(values)
    v = values[order]
    new = np.r_[True, v[1:] != v[:-1]][: len(v)]
    rank = np.cumsum(new) - 1
    alone = np.bincount(rank, minlength=1) == 1
    out = np.empty(len(v), np.int64)
    out[order] = np.where(alone[rank], -1, rank)
    return out


def doubled(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
    """The rank of every window of some strings, -1 where it occurs once: rounds of sorted pairs of ranks at growing offsets.

    A round's rank of `h` bytes at a place and the rank `h` bytes further on make the pair whose order is the rank of 2 * h bytes;
    the last round overlaps so that `window` bytes are covered. Places whose rank is unique leave, with all that begin there.
    """
    at = ranges(begin, size - 7)
    rank = np.full(len(raw), -1, np.int64)
    rank[at] = ranked(word_view(raw)[at])
    have = 8
    while have < window:
        step = min(have, window - have)
        have += step
        at = ranges(begin, size - have + 1)
        both = at[(rank[at] >= 0) & (rank[at + step] >= 0)]
        pair = rank[both] * (int(rank.max()) + 1) + rank[both + step]
        rank = np.full(len(raw), -1, np.int64)
        rank[both] = ranked(pair)
    return rank


def least_by_window(key: np.ndarray, windows: np.ndarray, least: np.ndarray, raw: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first window of each segment, smallest id that has it of every window), of segments in any order."""
    size = windows + window - 1
    begin, first = np.cumsum(size) - size, np.cumsum(windows) - windows
    content = contents(word_view(raw), begin, begin + windows - 1, window)
    order = np.lexsort((content, key))
    k, c = key[order], content[order]
    head = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
    cls = np.empty(len(order), np.int64)
    cls[order] = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(order)]))
    own, own_key = np.minimum.reduceat(least[order], head), k[head]
    # only where a key has several classes can windows of unequal segments be equal
    same = np.r_[own_key[1:] == own_key[:-1], False]
    open_ = np.flatnonzero(same | np.r_[False, same[:-1]])
    rep = order[head]
    w = windows[rep]
    at = np.cumsum(w) - w
    out = np.repeat(own, w)
    if len(open_):
        sizes = size[rep[open_]]
        text = np.r_[raw[ranges(begin[rep[open_]], sizes)], np.zeros(8, np.uint8)]
        start = np.cumsum(sizes) - sizes
        rank = doubled(text, start, sizes, window)
        rank, place = rank[ranges(start, w[open_])], ranges(at[open_], w[open_])
        rank, place = rank[rank >= 0], place[rank >= 0]
        if len(rank):
            order = np.argsort(rank, kind="stable")
            r, p = rank[order], place[order]
            head = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            out[p] = np.repeat(np.minimum.reduceat(out[p], head), np.diff(np.r_[head, len(r)]))
    return first, out[ranges(at[cls], windows)]


def _answer_segments(rows: pa.Table, window: int) -> pa.Table:
    rows = rows.to_pylist()
    key, least = (np.concatenate([np.frombuffer(r[c], kind) for r in rows]) for c, kind in (("keys", np.uint64), ("least", np.int64)))
    windows = np.concatenate([np.frombuffer(r["windows"], np.uint8) for r in rows]).astype(np.int64)
    raw = np.frombuffer(b"".join([*(r["blob"] for r in rows), bytes(8)]), np.uint8)
    first, ids = least_by_window(key, windows, least, raw, window)
    # runs of windows with one smallest id, begun anew in each segment
    begins = np.zeros(len(ids), bool)
    begins[first] = True
    begins[1:] |= ids[1:] != ids[:-1]
    run = np.flatnonzero(begins)
    count = np.diff(np.r_[run, len(ids)]).astype(np.uint8)
    of = np.searchsorted(first, run, "right") - 1
    runs = np.bincount(of, minlength=len(first)).astype(np.uint8)
    out, s, r0 = [], 0, 0
    for r in rows:
        e = s + len(r["keys"]) // 8
        r1 = r0 + int(runs[s:e].sum())
        out.append({"unit": r["unit"], "bucket": r["bucket"], "runs": runs[s:e].tobytes(), "counts": count[r0:r1].tobytes(), "least": ids[run[r0:r1]].tobytes()})
        s, r0 = e, r1
    return pa.Table.from_pylist(out, _FOUND)


def _remove(batches: Iterator[pa.RecordBatch], window: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            unit = Unit(row, window)
            unit.shared(row["answer"] or [])
            order, head, _ = unit.classes()
            cover = np.zeros(unit.n + 1, np.int32)
            if row["found"]:
                runs = np.concatenate([np.frombuffer(f["runs"], np.uint8) for f in row["found"]]).astype(np.int64)
                count = np.concatenate([np.frombuffer(f["counts"], np.uint8) for f in row["found"]]).astype(np.int64)
                least = np.concatenate([np.frombuffer(f["least"], np.int64) for f in row["found"]])
                cls = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(order)]))
                took = runs[cls]
                at = ranges((np.cumsum(runs) - runs)[cls], took)
                into = np.cumsum(count) - count
                lo = np.repeat(unit.lo[order] - into[(np.cumsum(runs) - runs)[cls]], took) + into[at]
                gone = np.repeat(unit.ids[unit.doc[order]], took) > least[at]
                lo, n = lo[gone], count[at][gone]
                np.add.at(cover, lo, 1)
                np.subtract.at(cover, lo + n - 1 + window, 1)
            gone = np.cumsum(cover)[: unit.n] > 0
            out: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
            for i, null, end, size in zip(unit.ids.tolist(), row["nulls"], unit.ends.tolist(), unit.sizes.tolist(), strict=True):
                raw, off = unit.raw[end - size : end], gone[end - size : end]
                removed = int(off.sum())
                kept = raw[~off].tobytes() if removed else raw.tobytes()
                spans = int((off[1:] & ~off[:-1]).sum()) + bool(off[0]) if removed else 0
                for c, v in zip(out, (None if null else i, size, removed, spans, kept if texts else hashlib.sha256(kept).hexdigest()), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary() if texts else pa.string())]))


def remove_seen_bytes(docs: DataFrame, window: int = 50, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, and kept, the bytes left (`digest`: their SHA-256).

    A byte goes if a string of `window` bytes around it also starts in a document with a smaller id; strings lie within one
    document's UTF-8 bytes, may overlap and are judged on the input.

    Suffixes are ranked by prefix doubling, with positions dealt out so that each sort stays in one task. Every window has an
    anchor, the gram of two fifths of its bytes with the smallest hash, and equal windows have equal anchors. First round: the
    grams at anchors, sorted by bucket of their key; those that no second document has are unique, and all windows on them
    leave. Next, runs of windows on the others are sent to their key's bucket, equal ones of some documents once, with their
    smallest id; there pairs of ranks at growing offsets are sorted and ranked anew until a place is unique or `window` bytes
    are covered. Back come the smallest ids, run by run. Documents are written once, in units, as a table bucketed by unit,
    so only keys, runs and answers travel after that. Keys are checked by the bytes at them; 64-bit hashes of the bytes stand for
    equal runs of one key.

    What a task holds: a unit of documents, or a bucket, of which there are as many as the text's size asks for. A run that is
    everywhere costs one entry a unit; very common keys are dealt out by window instead.

    Null texts are empty. A row with a null id loses what any row with an id has and takes nothing from others; rows that share
    an id take nothing from each other. Other columns are not read. An empty table gives an empty one. `window` is 24 to 200.
    """
    if not 24 <= window <= 200:
        raise ValueError("window must be 24 to 200")
    spark = prepare(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    bits = max(6, (-(-total // BUCKET_BYTES) - 1).bit_length())
    made = base.mapInArrow(lambda it: _make_units(it, UNIT_BYTES), _ddl(_UNIT))
    units = bucketed_table(spark, made, "units", "unit", max(1, -(-total // PART_BYTES)))

    asked = units.mapInArrow(lambda it: _ask_keys(it, window, bits), _ddl(_KEYS))
    hot = HOT_UNITS
    alive = asked.groupBy("bucket").applyInArrow(lambda t: _answer_keys(t, hot), _ddl(_ALIVE))
    alive = work_table(spark, alive.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "alive", "hot"))).alias("answer")), "alive")
    known = units.join(alive.hint("merge"), "unit", "left")
    asked = known.mapInArrow(lambda it: _ask_segments(it, window, bits), _ddl(_SEGMENTS))
    found = asked.groupBy("bucket").applyInArrow(lambda t: _answer_segments(t, window), _ddl(_FOUND))
    found = work_table(spark, found.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("bucket", "runs", "counts", "least"))).alias("found")), "found")
    both = known.join(found.hint("merge"), "unit", "left")
    return both.mapInArrow(lambda it: _remove(it, window, not digest), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}")
