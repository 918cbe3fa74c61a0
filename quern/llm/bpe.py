"""Byte-pair encoding by a segment tree over the ranks of adjacent pairs, and decoding."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._common import CACHE_WORDS, holds, prepare, text_runs, working

NONE = np.int64(1) << 40  # a rank above all others
TEXT_RUN = 4_000_000  # bytes of text that are cut into parts at a time
_SPACE = r"\t-\r \x85\xa0  -     　"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: Latin-1's own, others from U+0100 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class PairTree:
    """One word's merges: leaves are the ranks of adjacent pairs, each inner node the least (rank, place) below it.

    The root is the leftmost lowest-rank merge. A merge changes at most three leaves, each mended on its way to the root.
    """

    def __init__(self, symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]):
        self.ids, self.ranks, n = list(symbols), ranks, len(symbols)
        self.size = 1 << max(0, n - 1).bit_length()
        self.next, self.prev = [*range(1, n), -1], [*range(-1, n - 1)]
        self.tree = [(int(NONE), 0)] * (2 * self.size)
        for i in range(n - 1):
            self.tree[self.size + i] = self._leaf(i)
        for k in range(self.size - 1, 0, -1):
            self.tree[k] = min(self.tree[2 * k], self.tree[2 * k + 1])

    def _leaf(self, i: int) -> tuple[int, int]:
        j = self.next[i]
        found = self.ranks.get((self.ids[i], self.ids[j])) if j >= 0 else None
        return (found[0] if found else int(NONE), i)

    def _set(self, i: int, value: tuple[int, int]) -> None:
        k = self.size + i
        self.tree[k] = value
        while k > 1:
            k >>= 1
            self.tree[k] = min(self.tree[2 * k], self.tree[2 * k + 1])

    def run(self) -> list[int]:
        while len(self.ids) > 1 and self.tree[1][0] < NONE:
            i = self.tree[1][1]
            j = self.next[i]
            self.ids[i] = self.ranks[self.ids[i], self.ids[j]][1]
            self.next[i] = k = self.next[j]
            if k >= 0:
                self.prev[k] = i
            self._set(j, (int(NONE), j))
            self._set(i, self._leaf(i))
            if (p := self.prev[i]) >= 0:
                self._set(p, self._leaf(p))
        out, i = [], 0 if self.ids else -1
        while i >= 0:
            out.append(self.ids[i])
            i = self.next[i]
        return out


class WordBpe:
    """The encoder and decoder that a tokenizer file of the word-BPE kind describes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in reversed(list(enumerate(merges)))}
        keys = np.array([a << 20 | b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rank_of = np.array([r for r, _ in self.ranks.values()], np.int64)[order]
        self.made = np.zeros(len(merges), np.int64)
        for r, new in self.ranks.values():
            self.made[r] = new
        chars = byte_chars()
        self.inner = np.array([self.vocab[c] for c in chars], np.int64)
        self.last = np.array([self.vocab[c + self.end] for c in chars], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")

    def lowered(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text) if not text.isascii() else text
        return text.replace("Σ", "σ").lower()  # letter by letter: a capital sigma never becomes a final one

    def units(self, text: str) -> list[int | bytes]:
        """Special ids and the UTF-8 of words, in order."""
        if text.isalpha() and text.islower() and unicodedata.is_normalized("NFC", text):
            return [text.encode()]
        out: list[int | bytes] = []
        for part in self.split_special.split(text) if "<|" in text else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                out += [p.encode("utf-8", "surrogatepass") for p in self.pieces.findall(self.lowered(part))]
        return out

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NONE)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word (a non-empty UTF-8 piece). Words of up to 64 bytes go through the trees side by side."""
        out: list = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((0, 1), (1, 8), (8, 16), (16, 32), (32, 64)):
            at = np.flatnonzero((sizes > low) & (sizes <= high))
            for part in (at[i : i + 65536] for i in range(0, len(at), 65536)):
                for i, ids in zip(part, self._side_by_side([words[i] for i in part], sizes[part], high), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(sizes > 64):
            raw = np.frombuffer(words[i], np.uint8)
            ids = self.inner[raw].tolist()
            ids[-1] = int(self.last[raw[-1]])
            out[i] = np.array(PairTree(ids, self.ranks).run(), np.uint32)
        return out

    def _side_by_side(self, words: list[bytes], sizes: np.ndarray, width: int) -> Iterator[np.ndarray]:
        n, w = len(words), width
        raw = np.frombuffer(b"".join(x.ljust(w, b"\0") for x in words), np.uint8).reshape(n, w)
        ids = self.inner[raw]
        rows = np.arange(n)
        ids[rows, sizes - 1] = self.last[raw[rows, sizes - 1]]
        alive = np.arange(w) < sizes[:, None]
        if w > 1:
            nxt = np.tile(np.arange(1, w + 1), (n, 1))
            prv = np.tile(np.arange(-1, w - 1), (n, 1))
            tree = np.full((n, 2 * w), NONE * w, np.int64)
            pair = alive[:, 1:]
            ranks = np.full((n, w), NONE, np.int64)
            ranks[:, :-1][pair] = self.pair_ranks(ids[:, :-1][pair], ids[:, 1:][pair])
            tree[:, w:] = ranks * w + np.arange(w)
            for level in range(w.bit_length() - 2, -1, -1):
                k = 1 << level
                tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
            live = np.flatnonzero(tree[:, 1] < NONE * w)
            while len(live):
                rank, i = np.divmod(tree[live, 1], w)
                j = nxt[live, i]
                k = nxt[live, j]
                ids[live, i] = self.made[rank]
                alive[live, j] = False
                nxt[live, i] = k
                more = k < sizes[live]
                prv[live[more], k[more]] = i[more]
                tree[live, w + j] = NONE * w + j
                new = np.full(len(live), NONE, np.int64)
                new[more] = self.pair_ranks(ids[live[more], i[more]], ids[live[more], k[more]])
                tree[live, w + i] = new * w + i
                p = prv[live, i]
                has = p >= 0
                tree[live[has], w + p[has]] = self.pair_ranks(ids[live[has], p[has]], ids[live[has], i[has]]) * w + p[has]
                nodes = w + np.stack([j, i, np.where(has, p, i)])
                for _ in range(w.bit_length() - 1):
                    nodes >>= 1
                    tree[live, nodes] = np.minimum(tree[live, 2 * nodes], tree[live, 2 * nodes + 1])
                live = live[tree[live, 1] < NONE * w]
        flat = ids[alive].astype(np.uint32)
        ends = np.cumsum(alive.sum(1))
        start = 0
        for end in ends.tolist():
            yield flat[start:end]
            start = end

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        units = [self.units(t) for t in texts]
        words = list({u for us in units for u in us if not isinstance(u, int)})
        ids: dict = dict(zip(words, self.encode_words(words), strict=True))
        ids.update((i, np.array([i], np.uint32)) for i in self.special.values())
        empty = np.empty(0, np.uint32)
        return [ids[us[0]] if len(us) == 1 else np.concatenate([ids[u] for u in us]) if us else empty for us in units]

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def decode(self, ids) -> str:
        """Tokens joined by a space, special ones too: this kind of file names no decoder. Unknown ids are left out."""
        return " ".join(self.token[i] for i in ids if i in self.token)


#: What may follow a word's letters and is a piece of its own; no apostrophe and no angle bracket.
TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


def core_of(part: str) -> tuple[str, str] | None:
    """A part's letters, lower-cased, and what follows them, if it is no more than that and lower-casing is letter by letter."""
    letters = part.rstrip(TAIL)
    if not letters.isalpha():
        return None
    if not letters.isascii() and ("\u03a3" in letters or not unicodedata.is_normalized("NFC", part)):
        return None
    low = letters.lower()
    return (low, part[len(letters) :]) if low.isalpha() else None


_ASCII_PART = "^(?P<core>[A-Za-z]+)(?P<tail>[" + "".join("\\" + c for c in TAIL) + "]*)$"


def split_parts(parts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """core_of() of each part; a part that has none is a core of its own, with nothing after it."""
    found = pc.extract_regex(parts, _ASCII_PART)
    plain = found.is_valid()
    cores = pc.if_else(plain, pc.ascii_lower(pc.struct_field(found, "core")), parts)
    tails = pc.if_else(plain, pc.struct_field(found, "tail"), "")
    other = pc.invert(pc.or_(plain, pc.string_is_ascii(parts)))
    if pc.any(other).as_py():
        pairs = [core_of(p) or (p, "") for p in parts.filter(other).to_pylist()]
        cores = pc.replace_with_mask(cores, other, pa.array([c for c, _ in pairs], pa.string()))
        tails = pc.replace_with_mask(tails, other, pa.array([t for _, t in pairs], pa.string()))
    return cores, tails


class TextBpe:
    """Whole texts by their space-separated parts, the letters of each encoded once while they are cached.

    No rule of the tokenizer looks across a space or a line feed, or joins letters with what is none, so a text's ids are
    those of its parts in order, and a part's those of its letters and of what follows them.
    """

    def __init__(self, encode_many, decode=None, most: int = CACHE_WORDS):
        self.encode_many, self.decode, self.most = encode_many, decode, most
        self.ids: dict[str, bytes] = {"": b""}
        self.text: dict[str, str] = {"": ""}

    def learn(self, cores: list[str]) -> None:
        """Put these distinct cores into the caches."""
        todo = [c for c in cores if c not in self.ids]
        if len(self.ids) + len(todo) > self.most:
            self.ids, self.text = {"": b""}, {"": ""}
            todo = [c for c in cores if c]
        for start in range(0, len(todo), 50_000):
            some = todo[start : start + 50_000]
            for core, ids in zip(some, self.encode_many(some), strict=True):
                self.ids[core] = ids.tobytes()
                if self.decode:
                    self.text[core] = " " + self.decode(ids.tolist()) if len(ids) else ""

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and where each text's begin and the last one's end."""
        ids, ends, _ = self._run(texts, False)
        return ids, ends

    def round_trip(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """encode(), and each text's decoded form in UTF-8."""
        return self._run(texts, True)

    def _run(self, texts: pa.Array, decoded: bool) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        parts = lists.flatten().dictionary_encode()
        coded = [x.dictionary_encode() for x in split_parts(parts.dictionary)]
        names = [x.dictionary.to_pylist() for x in coded]
        self.learn(list(dict.fromkeys(names[0] + names[1])))
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])

        def all_of(cache: dict, kind: pa.DataType, nothing) -> tuple[np.ndarray, np.ndarray]:
            core, tail = (pa.array([cache[n] for n in some], kind).take(x.indices) for some, x in zip(names, coded, strict=True))
            return _joined(pc.binary_join_element_wise(core, tail, pa.scalar(nothing, kind)).take(parts.indices), at)

        raw, ends = all_of(self.ids, pa.binary(), b"")
        out = []
        if decoded:
            text, cuts = all_of(self.text, pa.string(), "")
            view = memoryview(text)
            out = [bytes(view[a + 1 : z]) for a, z in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
        return np.frombuffer(raw, "<u4"), ends // 4, out


def _joined(values: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values side by side, and their ends at the places `at`."""
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)[at]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8), ends - ends[0]


_LOADED: dict[str, TextBpe] = {}
holds("bpe", _LOADED.clear)


def loaded(path: str) -> TextBpe:
    if path not in _LOADED:
        bpe = WordBpe(path)
        _LOADED[path] = TextBpe(bpe.encode_many, bpe.decode)
    return _LOADED[path]


def bpe_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, ids (array<int>) and decoded of each text; with `digest` n_tokens, ids_sha256 and decoded_sha256 instead.

    Ids are those of the tokenizers library for the file `vocabulary` without added special tokens; decoded is its decode()
    of them, special tokens kept. One pass without a shuffle; a task holds a bounded run of texts and bounded caches.
    A null text counts as empty (no ids, empty decoded). A null or repeated id is passed on. Other columns are not read.
    An empty table gives an empty one.
    """
    prepare(docs.sparkSession)

    def run(batches):
        working("bpe")
        bpe = loaded(vocabulary)
        for batch in batches:
            for row, texts in text_runs(batch, 1, TEXT_RUN):
                own = batch.column(0).slice(row, len(texts))
                ids, ends, decoded = bpe.round_trip(texts)
                if digest:
                    view, at = memoryview(ids).cast("B"), (4 * ends).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [own, pa.array(np.diff(ends)), pa.array([hashlib.sha256(view[a:z]).hexdigest() for a, z in zip(at, at[1:], strict=False)]), pa.array([hashlib.sha256(d).hexdigest() for d in decoded])],
                        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                    )
                else:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([own, lists, pa.array(decoded, pa.binary()).cast(pa.string())], names=["doc_id", "ids", "decoded"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>, decoded string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
