"""Language-model scoring with an Elias-Fano trigram trie in memory-mapped levels.

Training counts every word, every pair and every triple of neighbours of all training texts; all are stored. Level 1 has the
words (sorted 63-bit hashes, exact counts). Level n has, context by context, the words that follow each entry of level n - 1:
monotone Elias-Fano pointers to each context's run, the run's words in order, and 8-bit quantised log10 discounted
probabilities and back-off weights. A query finds its context's run by the pointers and searches its successor in that run.

    p1(w) = (n(w) + 1) / (N + V + 1)    p(w | c) = max(n(c, w) - DISCOUNT, 0) / n(c) + DISCOUNT * distinct(c) / n(c) * p(w | c')

with c' the context one word shorter; a context never seen gives p(w | c'). The start of a text is a context of its own.

A level is a list of files, each with a range of keys (context, word) of about BUCKET_TOKENS training tokens. The counts of
one level deal out the next: its writers report after which entries another share of the tokens is full, so no file is larger
than the others, and a context with more tokens than a file takes is split between files by its successors.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._common import fresh_path, hash64, holds, prepare, split_words, text_runs, working
from quern.llm.token_output import put

#: Words of an entry at most; what entries give to the words their context leaves out.
ORDER, DISCOUNT = 3, 0.75
#: Training tokens of a file's range, and shares of it that boundaries are chosen from; keys a task holds before it passes
#: their counts on; bytes of text that are read into words at a time.
BUCKET_TOKENS, SHARES, HELD_KEYS, TEXT_RUN = 2_000_000, 4, 2_000_000, 10_000_000
#: Files that a worker keeps mapped, and bytes of files it keeps where the store cannot be mapped.
OPEN_FILES, OPEN_BYTES = 20_000, 200_000_000
END_HASH = 0x5EED_0FE4D  # the end of a text
EVERY = 64  # ones between the entries of a directory


# ---- files of arrays ----


def pack_arrays(arrays: dict[str, np.ndarray], **info) -> bytes:
    """A JSON header line, then each array at a multiple of 64 bytes."""
    at, meta, parts = 0, {}, []
    for k, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        meta[k] = [a.dtype.str, len(a), at]
        parts.append(raw + b"\0" * (-len(raw) % 64))
        at += len(parts[-1])
    head = json.dumps({"arrays": meta, "info": info}).encode()
    head = len(head).to_bytes(8, "little") + head
    return head + b"\0" * (-len(head) % 64) + b"".join(parts)


_MAPS: OrderedDict[str, tuple[dict[str, np.ndarray], dict, int]] = OrderedDict()


def open_arrays(uri: str) -> tuple[dict[str, np.ndarray], dict]:
    """Memory maps of the arrays; of a store that cannot be mapped, copies in memory, the latest used of bounded size."""
    if uri in _MAPS:
        _MAPS.move_to_end(uri)
        return _MAPS[uri][:2]
    fs, path = pafs.FileSystem.from_uri(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        raw, held = np.asarray(np.memmap(path, np.uint8, "r")), 0
    else:
        with fs.open_input_stream(path) as f:
            raw = np.frombuffer(f.read(), np.uint8)
        held = len(raw)
    n = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + n].tobytes())
    first = -(-(8 + n) // 64) * 64
    arrays = {k: raw[first + at : first + at + size * np.dtype(kind).itemsize].view(kind) for k, (kind, size, at) in head["arrays"].items()}
    _MAPS[uri] = arrays, head["info"], held
    while len(_MAPS) > 1 and (len(_MAPS) > OPEN_FILES or sum(x[2] for x in _MAPS.values()) > OPEN_BYTES):
        _MAPS.popitem(last=False)
    return arrays, head["info"]


holds("language model", lambda: (_MAPS.clear(), _OPEN.clear()))


# ---- Elias-Fano ----


def ef_pack(values: np.ndarray, universe: int, name: str) -> dict[str, np.ndarray]:
    """A non-decreasing sequence below `universe`: low bits side by side, high bits in unary, a directory of every 64th one."""
    n = len(values)
    low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
    v = values.astype(np.uint64)
    bits = np.zeros(-(-((universe >> low_bits) + n + 2) // 64) * 64, bool)
    ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    bits[ones] = True
    low = np.packbits((v[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)).astype(bool).ravel(), bitorder="little")
    low = np.concatenate([low, np.zeros(16 + -len(low) % 8, np.uint8)]).view(np.uint64)
    high = np.packbits(bits, bitorder="little").view(np.uint64)
    return {f"{name}_low": low, f"{name}_high": high, f"{name}_ones": ones[::EVERY].astype(np.int64), f"{name}_shape": np.array([n, low_bits], np.int64)}


def _spread(byte: int) -> np.uint64:
    return np.uint64(byte * 0x0101_0101_0101_0101)


#: Place of the r-th one of a byte, at 8 * byte + r.
_IN_BYTE = np.array([[*(i for i in range(8) if b >> i & 1), *[0] * 8][:8] for b in range(256)], np.uint8).ravel()


def select_in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The place of the r-th one of each word, which has more than r: the byte by sums of all bytes at once, then a table."""
    u = np.uint64
    s = word - (word >> u(1) & _spread(0x55))
    s = (s & _spread(0x33)) + (s >> u(2) & _spread(0x33))
    s = (s + (s >> u(4)) & _spread(0x0F)) * _spread(1)  # ones up to and with each byte
    r = r.astype(np.uint64)
    before = np.bitwise_count(((r * _spread(1) | _spread(0x80)) - s) & _spread(0x80)).astype(np.uint64) << u(3)
    r -= (s << u(8)) >> before & u(0xFF)
    return (before + _IN_BYTE[((word >> before & u(0xFF)) << u(3)) + r]).astype(np.int64)


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.low, self.high, self.ones = (arrays[f"{name}_{k}"] for k in ("low", "high", "ones"))
        self.n, self.low_bits = map(int, arrays[f"{name}_shape"])

    def at(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        at = self.ones[i // EVERY]
        word, left = at >> 6, i % EVERY
        here = self.high[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) << (at & 63).astype(np.uint64))
        count = np.bitwise_count(here).astype(np.int64)
        go = np.flatnonzero(left >= count)
        while len(go):
            left[go] -= count[go]
            word[go] += 1
            here[go] = self.high[word[go]]
            count[go] = np.bitwise_count(here[go])
            go = go[left[go] >= count[go]]
        high = (word << 6) + select_in_word(here, left) - i
        if not self.low_bits:
            return high
        bit = i * self.low_bits
        word, off = bit >> 6, (bit & 63).astype(np.uint64)
        up = np.where(off > 0, self.low[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        low = ((self.low[word] >> off) | up) & np.uint64((1 << self.low_bits) - 1)
        return (high << self.low_bits) | low.astype(np.int64)


# ---- levels ----


def word_hash(word: str) -> int:
    return hash64(word) >> 1


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of some texts the distinct words (A-Z lower-cased), for each word in order which it is, and how many each text has."""
    words, sizes = split_words(texts, lower=True)
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), sizes


def hashes_of(words: pa.Array) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words)) >> np.uint64(1)).astype(np.int64)


class Words:
    """Level 1 over all its files: word hash -> id and count. Ids are places in the order of hashes."""

    def __init__(self, files: list[tuple[int, str, int]]):
        self.files = files
        self.first = np.array([f for f, _, _ in files], np.int64)
        self.before = np.concatenate([[0], np.cumsum([n for _, _, n in files])]).astype(np.int64)
        self.size = int(self.before[-1])

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        order = np.argsort(h)
        bounds = np.append(np.searchsorted(h[order], self.first), len(h))
        for p, (x, y) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
            if x < y:
                at = order[x:y]
                a, _ = open_arrays(self.files[p][1])
                k = np.minimum(np.searchsorted(a["hash"], h[at]), len(a["hash"]) - 1)
                same = a["hash"][k] == h[at]
                ids[at[same]] = k[same] + self.before[p]
                counts[at[same]] = a["count"][k[same]]
        return ids, counts


@dataclass
class Level:
    """The files of one level: the least key of each one's range, its place (empty: no entry), entries of all files before."""

    bounds: np.ndarray
    uris: list[str]
    before: np.ndarray
    split: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # contexts in several files, in order
    split_back: np.ndarray = field(default_factory=lambda: np.empty(0))  # their back-off weights, exact

    def find(self, keys: np.ndarray, shift: int, only_place: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of keys in order: the entry's place (-1: none), its discounted probability (0: none), its context's back-off (1: new)."""
        place, own, back = np.full(len(keys), -1, np.int64), np.zeros(len(keys)), np.ones(len(keys))
        cuts = np.append(np.searchsorted(keys, self.bounds), len(keys))
        for p, (x, y) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)):
            if x == y or not self.uris[p]:
                continue
            a, info = open_arrays(self.uris[p])
            context, word = keys[x:y] >> shift, keys[x:y] & ((1 << shift) - 1)
            inside = np.flatnonzero((context >= info["first"]) & (context < info["after"]))
            context, word = context[inside] - info["first"], word[inside]
            if not len(inside):
                continue
            new = np.flatnonzero(np.diff(context, prepend=-1))
            one = context[new]
            size = np.diff(np.append(new, len(context)))
            pointer = EliasFano(a, "pointer")
            low, high = (np.repeat(pointer.at(c), size) for c in (one, one + 1))
            end = high.copy()
            todo = np.flatnonzero(low < high)
            while len(todo):
                mid = (low[todo] + high[todo]) >> 1
                less = (a["low"][mid] | a["high"][mid].astype(np.int64) << 16) < word[todo]
                low[todo] = np.where(less, mid + 1, low[todo])
                high[todo] = np.where(less, high[todo], mid)
                todo = todo[low[todo] < high[todo]]
            hit = np.flatnonzero(low < end)
            hit = hit[(a["low"][low[hit]] | a["high"][low[hit]].astype(np.int64) << 16) == word[hit]]
            place[x + inside[hit]] = low[hit] + self.before[p]
            if not only_place:
                own[x + inside[hit]] = 10 ** (info["prob_low"] + a["prob"][low[hit]] * info["prob_step"])
                code = a["back"][one]
                back[x + inside] = np.repeat(np.where(code < 255, 10 ** (info["back_low"] + code * info["back_step"]), 1.0), size)
        if len(self.split) and not only_place:
            k = np.minimum(np.searchsorted(self.split, keys >> shift), len(self.split) - 1)
            back = np.where(self.split[k] == keys >> shift, self.split_back[k], back)
        return place, own, back


@dataclass
class Model:
    words: list[tuple[int, str, int]]  # of each file of level 1 the least hash, the place and the number of words
    levels: list[Level]
    total: int
    docs: int

    def open(self) -> Opened:
        key = tuple(u for _, u, _ in self.words)
        if key not in _OPEN:
            _OPEN.clear()
            _OPEN[key] = Opened(self)
        _OPEN[key].levels = self.levels
        return _OPEN[key]


_OPEN: dict[tuple, Opened] = {}


class Opened:
    def __init__(self, m: Model):
        self.words, self.levels = Words(m.words), m.levels
        self.start = self.words.size  # the context before a text; as a word, one that is unknown
        self.shift = self.start.bit_length()
        self.floor = m.total + self.words.size + 1
        self.end, self.end_count = (int(x[0]) for x in self.words.ids(np.array([END_HASH], np.int64)))

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words and ends one after another (-1: unknown), their counts, and where each text begins."""
        words, which, sizes = words_of(texts)
        known, known_counts = self.words.ids(hashes_of(words))
        last = np.cumsum(sizes + 1) - 1
        inner = np.ones(int(sizes.sum()) + len(sizes), bool)
        inner[last] = False
        ids, counts = np.full(len(inner), self.end, np.int64), np.full(len(inner), self.end_count, np.int64)
        ids[inner], counts[inner] = known[which], known_counts[which]
        return ids, counts, last - sizes

    def look(self, level: Level, context: np.ndarray, word: np.ndarray, only_place: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Level.find() of (context, word) in any order; -1 is no context, which finds nothing and backs off by 1."""
        at = np.flatnonzero(context >= 0)
        key, which = np.unique(context[at] << self.shift | np.where(word[at] < 0, self.start, word[at]), return_inverse=True)
        out = np.full(len(word), -1, np.int64), np.zeros(len(word)), np.ones(len(word))
        for to, got in zip(out, level.find(key, self.shift, only_place), strict=True):
            to[at] = got[which]
        return out

    def contexts(self, ids: np.ndarray, begin: np.ndarray, places: np.ndarray | None) -> np.ndarray:
        """Contexts of the next level's entries that end at each word: `places` of the entries that end at the word before."""
        out = np.empty(len(ids), np.int64)
        out[1:] = (ids if places is None else places)[:-1]
        out[begin] = self.start if places is None else -1
        return out

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens, add-one log10 probability and the model's of each text, its end included."""
        ids, counts, begin = self.read(texts)
        p = (counts + 1) / self.floor
        base, places = np.log10(p), None
        for level in self.levels:
            places, own, back = self.look(level, self.contexts(ids, begin, places), ids)
            p = own + back * p
        known = np.add.reduceat((counts > 0).astype(np.int64), begin)
        return np.diff(np.append(begin, len(ids))), known, np.add.reduceat(base, begin), np.add.reduceat(np.log10(p), begin)


# ---- training ----


def squeezed(a: np.ndarray) -> bytes:
    """Non-negative integers, at least one, as planes of bytes, lowest first, as many as the largest needs: high planes compress well."""
    n = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def unsqueezed(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(-1, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.diff(k, prepend=-1))
    return k[first], np.add.reduceat(c, first) if len(first) else c


def counted(texts: DataFrame, keys_of: Callable[[pa.Array], np.ndarray], bounds: np.ndarray, finish: Callable[[int, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str, user: str) -> DataFrame:
    """What `finish` makes of (bucket, distinct keys in order, their counts), for each range of keys that `bounds` begin.

    `keys_of` gives the keys (0 to 2**63 - 1) of some texts (one column). A task counts its own keys and passes them on as one
    sorted block for each range, so a frequent key is one entry of each block, and what a range's task holds is at most the
    tokens of its range. Ranges without a key give nothing.
    """

    def count(batches) -> Iterator[pa.RecordBatch]:
        working(user)
        keys, counts, n = [], [], 0

        def blocks() -> pa.RecordBatch:
            k, c = summed(keys, counts)
            cuts = np.append(np.searchsorted(k, bounds), len(k)).tolist()
            got = [(b, x, y) for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if x < y]
            return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in got], pa.int32()), pa.array([y - x for _, x, y in got], pa.int32()), pa.array([squeezed(np.diff(k[x:y], prepend=0)) for _, x, y in got], pa.binary()), pa.array([squeezed(c[x:y]) for _, x, y in got], pa.binary())], names=["b", "n", "k", "c"])

        for batch in batches:
            for _, some in text_runs(batch, 0, TEXT_RUN):
                k, c = np.unique(keys_of(some), return_counts=True)
                keys.append(k)
                counts.append(c)
                n += len(k)
                if n >= HELD_KEYS:
                    yield blocks()
                    keys, counts, n = [], [], 0
        if n:
            yield blocks()

    def merge(batches) -> Iterator[pa.RecordBatch]:
        working(user)
        held: dict[int, list] = {}
        for batch in batches:
            for b, n, k, c in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.setdefault(b, []).append((np.cumsum(unsqueezed(k, n)), unsqueezed(c, n)))
        for b in sorted(held):
            yield from finish(b, *summed(*map(list, zip(*held.pop(b), strict=True))))

    return texts.mapInArrow(count, "b int, n int, k binary, c binary").repartitionById(len(bounds), F.col("b")).mapInArrow(merge, schema)


@dataclass
class Written:
    """What the files of a level report: of each (in order) the least key, place and entries; boundaries for the next level."""

    files: list[tuple[int, int, str, int]]
    full: np.ndarray  # entries after which another share of the tokens is full, over all files, in order
    large: dict[int, int]  # counts of entries that fill a share alone
    edges: dict[int, int]  # distinct successors of contexts that begin or end a file


def _write(texts: DataFrame, keys_of: Callable, bounds: np.ndarray, pack: Callable[[np.ndarray, np.ndarray], bytes], directory: str, share: int, shift: int) -> Written:
    """Count and write a level; a row for each file comes to the driver, and one number for each `share` tokens."""

    def finish(b: int, k: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        uri = f"{directory}/{b:07d}.level"
        put(uri, pack(k, c))
        total = np.cumsum(c)
        full = np.searchsorted(total, np.arange(share, int(total[-1]) + 1, share))
        large = np.flatnonzero(c >= share)
        context = k >> shift
        edges = [(int(x), int((context == x).sum())) for x in sorted({int(context[0]), int(context[-1])})]
        yield pa.RecordBatch.from_arrays(
            [pa.array([b], pa.int32()), pa.array([int(k[0])], pa.int64()), pa.array([uri]), pa.array([len(k)], pa.int64()), *(pa.array([x], pa.list_(pa.int64())) for x in (full.tolist(), large.tolist(), c[large].tolist(), [e[0] for e in edges], [e[1] for e in edges]))],
            names=["b", "first", "uri", "n", "full", "large", "counts", "edges", "distinct"],
        )

    schema = "b int, first long, uri string, n long, full array<long>, large array<long>, counts array<long>, edges array<long>, distinct array<long>"
    rows = sorted(counted(texts, keys_of, bounds, finish, schema, "language model").collect(), key=lambda r: r["b"])
    out, at = Written([], np.empty(0, np.int64), {}, {}), 0
    parts = []
    for r in rows:
        out.files.append((r["b"], r["first"], r["uri"], r["n"]))
        parts.append(np.array(r["full"], np.int64) + at)
        out.large.update((k + at, c) for k, c in zip(r["large"], r["counts"], strict=True))
        for e, d in zip(r["edges"], r["distinct"], strict=True):
            out.edges[e] = out.edges.get(e, 0) + d
        at += r["n"]
    out.full = np.concatenate(parts) if parts else out.full
    return out


def ranges(full: np.ndarray, words: np.ndarray, shift: int) -> tuple[np.ndarray, list[int]]:
    """Least keys (context, word) of the next level's files, and the contexts that are split between files.

    `full` names the contexts after which another share of the tokens is full; a context that is named for several files is
    split, by the words after which as large a share of all words is full.
    """
    named, times = np.unique(full[SHARES - 1 :: SHARES], return_counts=True)
    keys, split = [0], []
    for context, n in zip(named.tolist(), times.tolist(), strict=True):
        keys.append(context << shift)
        if n > 1 and len(words):
            cuts = {int(words[len(words) * j // n]) for j in range(1, n)} - {0}
            keys += [context << shift | w for w in sorted(cuts)]
            keys.append((context + 1) << shift)
            split += [context] if cuts else []
    return np.unique(np.array(keys, np.int64)), split


def _quantised(logs: np.ndarray, codes: int) -> tuple[np.ndarray, float, float]:
    low, high = (float(logs.min()), float(logs.max())) if len(logs) else (0.0, 0.0)
    step = (high - low) / (codes - 1) or 1.0
    return np.rint((logs - low) / step).astype(np.uint8), low, step


def pack_level(k: np.ndarray, c: np.ndarray, shift: int, totals: dict[int, int]) -> bytes:
    """A file of these keys and counts; `totals` has the counts of contexts that other files share."""
    context, word = k >> shift, k & ((1 << shift) - 1)
    first, after = int(context[0]), int(context[-1]) + 1
    rel = context - first
    distinct = np.bincount(rel, minlength=after - first)
    seen = np.bincount(rel, weights=c, minlength=after - first)
    for x in {first, after - 1} & totals.keys():
        seen[x - first] = totals[x]
    prob, prob_low, prob_step = _quantised(np.log10((c - DISCOUNT) / seen[rel]), 256)
    has = distinct > 0
    code, back_low, back_step = _quantised(np.log10(DISCOUNT * distinct[has] / seen[has]), 255)
    back = np.full(after - first, 255, np.uint8)
    back[has] = code
    arrays = ef_pack(np.concatenate([[0], np.cumsum(distinct)]), len(k) + 1, "pointer")
    high = (word >> 16).astype(np.uint8 if shift <= 24 else np.uint64)
    return pack_arrays(arrays | {"low": (word & 0xFFFF).astype(np.uint16), "high": high, "prob": prob, "back": back}, first=first, after=after, prob_low=prob_low, prob_step=prob_step, back_low=back_low, back_step=back_step)


def train(spark: SparkSession, texts: DataFrame, order: int | None = None) -> Model:
    """Count and write the levels of all texts (one column, null as empty)."""
    prepare(spark)
    order = order or ORDER
    n_docs, size = texts.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(texts.columns[0])))).first()
    if not n_docs:
        return Model([], [], 0, 0)
    # a word takes two bytes or more and each text has an end
    most_tokens = (size or 0) // 2 + 2 * n_docs
    buckets = max(1, -(-most_tokens // BUCKET_TOKENS))
    share = max(1, min(BUCKET_TOKENS, most_tokens // (2 * buckets)) // SHARES)

    def word_keys(some: pa.Array) -> np.ndarray:
        words, which, sizes = words_of(some)
        return np.concatenate([hashes_of(words)[which], np.full(len(sizes), END_HASH, np.int64)])

    def total_of(k: np.ndarray, c: np.ndarray) -> bytes:
        return pack_arrays({"hash": k, "count": c}, total=int(c.sum()))

    bounds = np.array([(1 << 63) * b // buckets for b in range(buckets)], np.int64)
    level = _write(texts, word_keys, bounds, total_of, fresh_path(spark, "lm-level1"), share, 0)
    total = sum(open_arrays(u)[1]["total"] for _, _, u, _ in level.files)
    model = Model([(f, u, n) for _, f, u, n in level.files], [], total, n_docs)
    words, start = level.full, sum(n for *_, n in level.files)
    shift = start.bit_length()
    # the start of a text is the last context of level 2
    level.full = np.append(level.full, np.full(n_docs // share, start, np.int64))
    level.large[start] = n_docs

    for n in range(2, order + 1):
        if sum(x for *_, x in level.files).bit_length() + shift > 62:
            raise OverflowError(f"{n}-grams: ids of contexts and words need more than 62 bits together")
        bounds, split = ranges(level.full, words, shift)
        totals = {x: level.large[x] for x in split}
        base = model

        def keys(some: pa.Array, base: Model = base) -> np.ndarray:
            opened = base.open()
            ids, _, begin = opened.read(some)
            context = opened.contexts(ids, begin, None)
            for lower in base.levels:
                context = opened.contexts(ids, begin, opened.look(lower, context, ids, only_place=True)[0])
            at = context >= 0
            return context[at] << opened.shift | ids[at]

        def pack(k: np.ndarray, c: np.ndarray, totals: dict[int, int] = totals) -> bytes:
            return pack_level(k, c, shift, totals)

        level = _write(texts, keys, bounds, pack, fresh_path(spark, f"lm-level{n}"), share, shift)
        uris, sizes = [""] * len(bounds), [0] * len(bounds)
        for b, _, uri, entries in level.files:
            uris[b], sizes[b] = uri, entries
        back = np.array([DISCOUNT * level.edges[x] / totals[x] if x in level.edges else 1.0 for x in split])
        model = Model(model.words, [*model.levels, Level(bounds, uris, np.concatenate([[0], np.cumsum(sizes)])[:-1], np.array(split, np.int64), back)], total, n_docs)
    return model


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row's whole text; one pass, no shuffle.

    A null or empty text is its end alone. An empty training set knows no token: each then has probability 1 / (0 + 0 + 1).
    Ids, null or repeated, are passed on; other columns are not read; an empty table gives an empty one.
    """
    prepare(docs.sparkSession)

    def run(batches) -> Iterator[pa.RecordBatch]:
        working("language model")
        opened = model.open()
        for batch in batches:
            for row, texts in text_runs(batch, 1, TEXT_RUN):
                n, known, base, own = opened.score(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(texts)), pa.array(n, pa.int64()), pa.array(known), pa.array(np.full(len(texts), model.total)), pa.array(base), pa.array(own)],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def lm_scores(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows where `training` holds, then score every row, as score_texts() says. Rows where it is null are not learned."""
    model = train(docs.sparkSession, docs.where(training).select(F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    return score_texts(docs, model, id_col, text_col)
