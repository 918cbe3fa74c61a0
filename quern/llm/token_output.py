"""Token-id files of directly addressable codes: any token is reached without decoding a block.

A file holds the ids of consecutive documents. An id is cut into 8-bit chunks, lowest first. Level 0 has the first chunk of
every id and a bitmap that says which ids go on; level k has the next chunk of those that do, and a bitmap of its own. A rank
directory (ones before every 512 bits) turns a place on one level into the place on the next with one popcount.

Layout, little-endian: magic `QDAC0001`, u64 documents, u64 ids, u64 levels, u64 size of each level; i64 document ids,
u8 1 where the id is null, u64 offsets (documents + 1); then for each level its chunks, its bitmap as u64 words (a last
level that nothing leaves has none: u64 0 words) and its directory of u64. Each section is padded to 8 bytes.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._common import fresh_path, holds, prepare, text_runs, working
from quern.llm.bpe import TEXT_RUN, TextBpe

MAGIC = b"QDAC0001"
BLOCK = 8  # 64-bit words in a block of the rank directory
#: Words that a worker keeps the ids of (about 200 bytes each); words the library encodes as one text; ids read at a time.
CACHE_PARTS, JOINED, READ_IDS = 900_000, 2000, 1 << 17
#: Ids after which a file is closed (a longer document still has one file).
FILE_IDS = 2_000_000


def _pad(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 8)


def pack(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The file of these documents; `ids` are all their ids in order."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        on = rest > 255
        levels.append((rest.astype(np.uint8), on))
        rest = rest[on] >> np.uint32(8)
        if not len(rest):
            break
    nulls = np.array([i is None for i in doc_ids], np.uint8)
    out = [MAGIC, np.array([len(doc_ids), len(ids), len(levels), *(len(c) for c, _ in levels)], "<u8").tobytes()]
    out += [np.array([i or 0 for i in doc_ids], "<i8").tobytes(), _pad(nulls.tobytes()), np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes()]
    for chunks, on in levels:
        bits = _pad(np.packbits(on, bitorder="little").tobytes()) if on.any() else b""
        words = np.frombuffer(bits, "<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.uint64)])[:-1:BLOCK] if len(words) else np.empty(0)
        out += [_pad(chunks.tobytes()), np.array([len(words)], "<u8").tobytes(), bits, ones.astype("<u8").tobytes()]
    return b"".join(out)


class DacFile:
    """Reads what pack() wrote, from bytes or a memory map, without decoding more than is asked for."""

    def __init__(self, raw):
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        at = 8

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, kind, n, at)
            at += -(-got.nbytes // 8) * 8
            return got

        n_docs, self.n_ids, n_levels = map(int, take("<u8", 3))
        sizes = take("<u8", n_levels).tolist()
        ids, nulls = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if x else i for i, x in zip(ids.tolist(), nulls.tolist(), strict=True)]
        self.offsets = take("<u8", n_docs + 1).astype(np.int64)
        self.levels = []
        for n in sizes:
            chunks = take("u1", n)
            words = take("<u8", int(take("<u8", 1)[0]))
            self.levels.append((chunks, words, take("<u8", -(-len(words) // BLOCK))))

    def at(self, place) -> np.ndarray:
        """The ids at these places, each by one access a level."""
        place = np.asarray(place, np.int64)
        out, todo = np.zeros(len(place), np.uint32), np.arange(len(place))
        for shift, (chunks, words, ones) in enumerate(self.levels):
            out[todo] |= chunks[place].astype(np.uint32) << np.uint32(8 * shift)
            if not len(words):
                break
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            go = (words[word] >> bit) & np.uint64(1) == 1
            todo, place, word, bit = todo[go], place[go], word[go], bit[go]
            before = ones[word // BLOCK].astype(np.int64)
            for k in range(BLOCK - 1):
                inner = word // BLOCK * BLOCK + k
                before += np.where(inner < word, np.bitwise_count(words[np.minimum(inner, len(words) - 1)]), 0)
            place = before + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
        return out

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out = np.zeros(self.n_ids, np.uint32)
        todo = np.arange(self.n_ids)
        for shift, (chunks, words, _) in enumerate(self.levels):
            out[todo] |= chunks.astype(np.uint32) << np.uint32(8 * shift)
            if not len(words):
                break
            todo = todo[np.unpackbits(words.view("u1"), count=len(chunks), bitorder="little").astype(bool)]
        return out

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        return self.documents(k, k + 1)

    def documents(self, first: int, after: int) -> np.ndarray:
        """The ids of some documents in a row, each reached by its place."""
        return self.at(np.arange(self.offsets[first], self.offsets[after]))


def put(uri: str, raw: bytes) -> None:
    """Write a file of the shared store whole: under a name of its own, then moved, so that a repeated task does no harm."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    own = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(raw)
    fs.move(own, path)


def get(uri: str) -> np.ndarray:
    """A file of the shared store: a memory map where that can be, else its bytes."""
    fs, path = pafs.FileSystem.from_uri(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.asarray(np.memmap(path, np.uint8, "r"))
    with fs.open_input_stream(path) as f:
        return np.frombuffer(f.read(), np.uint8)


class TokenStore:
    """Random access to the ids of many files, listed as write_token_files() does: (name, documents, ids) of each.

    Files are opened when they are first asked for. A place counts the ids of all documents, in id order.
    """

    def __init__(self, directory: str, files: list[tuple[str, int, int]]):
        self.directory, self.files = directory, sorted(files)
        self.starts = np.concatenate([[0], np.cumsum([n for _, _, n in self.files])]).astype(np.int64)
        self.opened: dict[int, DacFile] = {}

    def file(self, k: int) -> DacFile:
        if k not in self.opened:
            self.opened[k] = DacFile(get(f"{self.directory}/{self.files[k][0]}"))
        return self.opened[k]

    def at(self, places) -> np.ndarray:
        """The ids at these places of all files' ids."""
        places = np.asarray(places, np.int64)
        out, file = np.empty(len(places), np.uint32), np.searchsorted(self.starts, places, "right") - 1
        for k in np.unique(file).tolist():
            own = file == k
            out[own] = self.file(k).at(places[own] - self.starts[k])
        return out


_ENCODERS: dict[str, TextBpe] = {}
holds("token files", _ENCODERS.clear)


def library_encoder(vocabulary: str) -> TextBpe:
    """The tokenizers library for a file, each distinct word encoded once while it is cached.

    Words of letters go to the library many in one text, where the vocabulary marks the ends of words: the ids are cut there.
    """
    if vocabulary not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(vocabulary)
        t.no_truncation()
        t.no_padding()
        suffix = getattr(t.model, "end_of_word_suffix", None)
        ends = np.zeros(t.get_vocab_size() + 1, bool)
        if suffix:
            ends[[i for w, i in t.get_vocab().items() if w.endswith(suffix)]] = True

        def single(parts: list[str]) -> list[np.ndarray]:
            return [np.array(e.ids, np.uint32) for e in t.encode_batch_fast(parts, add_special_tokens=False)]

        def many(parts: list[str]) -> list[np.ndarray]:
            words = [p for p in parts if p.isalpha()] if suffix else []
            found = {}
            for some in (words[i : i + JOINED] for i in range(0, len(words), JOINED)):
                ids = np.array(t.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
                cuts = np.flatnonzero(ends[ids]) + 1
                found.update(zip(some, np.split(ids, cuts[:-1]) if len(cuts) == len(some) else single(some), strict=True))
            rest = [p for p in parts if p not in found]
            found.update(zip(rest, single(rest), strict=True))
            return [found[p] for p in parts]

        _ENCODERS[vocabulary] = TextBpe(many, most=CACHE_PARTS)
    return _ENCODERS[vocabulary]


def write_token_files(docs: DataFrame, vocabulary: str, directory: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of each text and `end_id` to `directory`, files and rows in ascending id order; one row per file.

    Columns: name, n_docs, n_ids; names sort as the ids do. The texts are dealt by ranges of the id, so each task has a run of
    the order and writes files of about FILE_IDS ids. A null text counts as empty (its end id remains), null ids come first,
    rows that repeat an id stay beside each other. An empty table gives no file.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")

    def run(batches) -> Iterator[pa.RecordBatch]:
        working("token files")
        bpe, task, seq = library_encoder(vocabulary), TaskContext.get().partitionId(), 0
        held_ids, held, sizes, n = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal held_ids, held, sizes, n, seq
            name = f"part-{task:06d}-{seq:05d}.dac"
            put(f"{directory}/{name}", pack(held_ids, np.concatenate(sizes), np.concatenate(held)))
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held_ids)], pa.int64()), pa.array([n], pa.int64())], names=["name", "n_docs", "n_ids"])
            held_ids, held, sizes, n, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            for row, texts in text_runs(batch, 1, TEXT_RUN):
                ids, ends = bpe.encode(texts)
                held_ids += batch.column(0).slice(row, len(texts)).to_pylist()
                held.append(np.insert(ids, ends[1:], end_id))
                sizes.append(np.diff(ends) + 1)
                n += len(held[-1])
                if n >= FILE_IDS:
                    yield close()
        if held:
            yield close()

    return rows.mapInArrow(run, "name string, n_docs long, n_ids long")


def read_token_files(files: DataFrame, directory: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian u32) of the files that write_token_files() listed.

    `start` counts the ids of all documents before, over all files. The list of files, one row for each 2 million ids or
    task, is read on the driver for its running sum; what comes from the files stays on the executors.
    """
    return _read(files, directory, "ids binary", bytes, pa.binary())


def _read(files: DataFrame, directory: str, field: str, of, kind: pa.DataType) -> DataFrame:
    spark = files.sparkSession
    listed = sorted(map(tuple, files.collect()))
    schema = f"doc_id long, start long, n_tokens long, {field}"
    if not listed:
        return spark.createDataFrame([], schema)
    before = np.concatenate([[0], np.cumsum([x[2] for x in listed])]).tolist()
    starts = spark.createDataFrame([(x[0], b) for x, b in zip(listed, before[:-1], strict=True)], "name string, before long")

    def run(batches) -> Iterator[pa.RecordBatch]:
        working("token files")
        for batch in batches:
            for path, raw in zip(batch.column(0), batch.column(1), strict=True):
                f, name, first = DacFile(raw.as_buffer()), path.as_py().rpartition("/")[2], 0
                while first < len(f.doc_ids):
                    after = max(first + 1, int(np.searchsorted(f.offsets, f.offsets[first] + READ_IDS, "right")) - 1)
                    view, at = memoryview(f.documents(first, after).astype("<u4")).cast("B"), (4 * (f.offsets[first : after + 1] - f.offsets[first])).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * (after - first)), pa.array(f.doc_ids[first:after], pa.int64()), pa.array(f.offsets[first:after]), pa.array(np.diff(f.offsets[first : after + 1])), pa.array([of(view[a:z]) for a, z in zip(at, at[1:], strict=False)], kind)],
                        names=["name", "doc_id", "own", "n_tokens", field.split()[0]],
                    )
                    first = after

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(directory).select("path", "content")
    got = raw.mapInArrow(run, f"name string, doc_id long, own long, n_tokens long, {field}")
    return got.join(starts, "name").select("doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", field.split()[0])


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", crc: bool = False) -> DataFrame:
    """Write the files and read them back, each document by its place: doc_id, start, n_tokens, ids; with `crc` ids_crc32 for ids.

    A null text counts as empty and has its end id alone; null ids come first, rows that repeat an id stay beside each other.
    Other columns are not read. An empty table gives an empty one.
    """
    spark = prepare(docs.sparkSession)
    directory = fresh_path(spark, "tokens")
    written = write_token_files(docs, vocabulary, directory, end_id, id_col, text_col)
    return _read(written, directory, "ids_crc32 long", zlib.crc32, pa.int64()) if crc else read_token_files(written, directory)
