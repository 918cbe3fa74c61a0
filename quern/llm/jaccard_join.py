"""Similarity join of word n-gram sets by signature trees.

Equal sets become one class. An ordered prefix of each class's set (an edit budget's worth of shingles and a few more) finds
which classes can be similar at all; these form cohorts, and each cohort, in blocks of bounded size, is joined by a dual walk
of signature trees: nodes hold the OR of their sets' token bitmaps and the range of their sizes, and a pair of nodes goes no
further where the largest possible overlap is too small. The links found are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._common import by_group, connected_components, drop_table, hashed_words, mix, prepare, shingles, text_runs, work_table, working
from quern.llm.lm import counted

#: Documents of which one is read for the order of shingles; times seen there from which a shingle comes late, or as many
#: more as leave HINT_MOST late ones at most. The order is a hint: any order gives the same links.
HINT_OF, HINT_SEEN, HINT_MOST = 8, 3, 1 << 22
#: Prefix entries of a bucket in which classes meet, and digests that a task keeps to give a prefix once.
BUCKET_TOKENS, HELD_DIGESTS = 1_500_000, 200_000
#: Classes that share a shingle: up to RUN they are paired, beyond they become one cohort without pairs.
RUN = 64
#: Classes and shingles of a cohort's block.
BLOCK_CLASSES, BLOCK_SHINGLES = 3000, 4_000_000
#: Children of a tree's node; bytes of exact bitmaps a block may take, and bits of hashed ones beyond that.
FAN, EXACT_BYTES, HASHED_BITS = 8, 128_000_000, 1 << 15


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Of each text the sorted 62-bit hashes of the distinct k-word shingles; of all words as one where there are fewer."""
    h, sizes = hashed_words(texts, lower=True)
    all_of = (shingles(h, k) >> np.uint64(2)).astype(np.int64)
    out, at = [], 0
    for n in sizes.tolist():
        if n >= k:
            out.append(np.unique(all_of[at : at + n - k + 1]))
        else:
            out.append((shingles(h[at : at + n], n) >> np.uint64(2)).astype(np.int64) if n else np.empty(0, np.int64))
        at += n
    return out


def shared_least(n: np.ndarray | int) -> np.ndarray | int:
    """Shingles that the prefixes of a similar pair must share (of the smaller's), at a cost of as many more in each prefix."""
    return np.maximum(1, n // 20)


def prefix_size(n: int, num: int, den: int) -> int:
    """Of a set of n: where two similar sets share all of shared_least(smaller) at least."""
    least = -(-num * n // den)  # of any similar set's overlap
    return n - least + min(least, int(shared_least(n)))


# ---- signature trees ----


def _popcounts(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, words: int = 16_000_000) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    step = max(1, words // max(1, a.shape[1]))
    for i in range(0, len(x), step):
        out[i : i + step] = np.bitwise_count(a[x[i : i + step]] & b[y[i : i + step]]).sum(1, dtype=np.int64)
    return out


class SignatureTree:
    """Sets in an order that keeps like sizes and like least tokens together, and nodes over FAN of them each."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        lost = sizes - np.bitwise_count(bits).sum(1, dtype=np.int64)  # tokens that share a bit with another of their set
        self.levels = [(bits, sizes, sizes, lost)]
        while len(self.levels[-1][0]) > 1:
            b, low, high, l = self.levels[-1]
            at = np.arange(0, len(b), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(l, at)))


def _possible(a: tuple, b: tuple, x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Of node pairs: sizes allow similarity, and so does the largest possible overlap."""
    low = np.maximum(a[1][x], b[1][y])
    ok = num * low <= den * np.minimum(a[2][x], b[2][y])
    x, y = x[ok], y[ok]
    most = _popcounts(a[0], b[0], x, y) + np.minimum(a[3][x], b[3][y])
    ok[ok] = (num + den) * most >= num * (a[1][x] + b[1][y])
    return ok


def tree_links(sets: list[np.ndarray], side: np.ndarray | None, num: int, den: int) -> np.ndarray:
    """A label for each set: the least place that links of Jaccard similarity >= num/den reach.

    With `side` (0 or 1 for each set) only links between sides are looked for. Pairs that are already one component are
    skipped, so a cluster of n like sets costs about n comparisons.
    """
    n = len(sets)
    label = np.arange(n)
    if n < 2:
        return label
    sizes = np.array([len(s) for s in sets])
    order = np.lexsort((np.array([s[0] if len(s) else 0 for s in sets]), sizes))
    flat = np.concatenate([sets[i] for i in order])
    row = np.repeat(np.arange(n), sizes[order])
    distinct, place = np.unique(flat, return_inverse=True)
    exact = n * len(distinct) <= 8 * EXACT_BYTES
    width = len(distinct) if exact else HASHED_BITS
    if not exact:
        place = (mix(flat.astype(np.uint64)) % np.uint64(width)).astype(np.int64)
    bits = np.zeros((n, -(-width // 64)), np.uint64)
    np.bitwise_or.at(bits.reshape(-1), row * bits.shape[1] + (place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    lost = sizes[order] - np.bitwise_count(bits).sum(1, dtype=np.int64)
    if side is None:
        members = [np.arange(n), np.arange(n)]
        trees = [SignatureTree(bits, sizes[order])] * 2
    else:
        members = [np.flatnonzero(side[order] == k) for k in (0, 1)]
        if not len(members[0]) or not len(members[1]):
            return label
        trees = [SignatureTree(bits[m], sizes[order][m]) for m in members]
    own = np.arange(n)  # labels by rank
    a, b = trees

    def join(x: np.ndarray, y: np.ndarray) -> None:
        while True:
            p, q = own[x], own[y]
            apart = p != q
            if not apart.any():
                return
            np.minimum.at(own, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
            while not np.array_equal(up := own[own], own):
                own[:] = up

    def walk(la: int, lb: int, x: np.ndarray, y: np.ndarray) -> None:
        """Of node pairs at levels la, lb, depth first in bounded batches."""
        step = 4096
        for i in range(0, len(x), step):
            p, q = x[i : i + step], y[i : i + step]
            if la == lb == 0:
                p, q = members[0][p], members[1][q]
                apart = (own[p] != own[q]) & (p != q) if side is not None else (own[p] != own[q]) & (p < q)
                p, q = p[apart], q[apart]
                s = sizes[order]
                fits = num * np.maximum(s[p], s[q]) <= den * np.minimum(s[p], s[q])
                p, q = p[fits], q[fits]
                both = _popcounts(bits, bits, p, q)
                if exact:
                    good = den * both >= num * (s[p] + s[q] - both)
                    join(p[good], q[good])
                else:
                    maybe = (num + den) * (both + np.minimum(lost[p], lost[q])) >= num * (s[p] + s[q])
                    for u, v in zip(p[maybe].tolist(), q[maybe].tolist(), strict=True):
                        if own[u] != own[v]:
                            common = len(np.intersect1d(sets[order[u]], sets[order[v]], assume_unique=True))
                            if den * common >= num * (s[u] + s[v] - common):
                                join(np.array([u]), np.array([v]))
                continue
            ok = _possible(a.levels[la], b.levels[lb], p, q, num, den)
            p, q = p[ok], q[ok]
            if la:
                p, q = np.repeat(p * FAN, FAN) + np.tile(np.arange(FAN), len(p)), np.repeat(q, FAN)
                keep = p < len(a.levels[la - 1][0])
                p, q = p[keep], q[keep]
            if lb:
                p, q = np.repeat(p, FAN), np.repeat(q * FAN, FAN) + np.tile(np.arange(FAN), len(q))
                keep = q < len(b.levels[lb - 1][0])
                p, q = p[keep], q[keep]
            if side is None:
                keep = p <= q
                p, q = p[keep], q[keep]
            walk(max(0, la - 1), max(0, lb - 1), p, q)

    walk(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))
    least = np.full(n, n)
    np.minimum.at(least, own, order)
    label[order] = least[own]
    return label


# ---- the join ----


def _hint(spark: SparkSession, docs: DataFrame, k: int) -> np.ndarray:
    """A bitmap of shingles that many documents have, as a sample sees it: bytes, at most 8 MB from each of eight tasks.

    At most HINT_MOST shingles are in it, the most frequent ones, so that it tells frequent from rare at every corpus size.
    """
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "content", F.lit(3)), F.lit(HINT_OF)) == 0).select("text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, size // (2 * HINT_OF * BUCKET_TOKENS))

    def finish(_, keys: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        often = c >= HINT_SEEN
        keys, c = keys[often], c[often]
        for i in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000]), pa.array(c[i : i + 100_000])], names=["k", "c"])

    bounds = np.array([(1 << 62) * b // buckets for b in range(buckets)], np.int64)
    hot = work_table(spark, counted(sample, lambda texts: np.concatenate(shingle_sets(texts, k)), bounds, finish, "k long, c long", "jaccard"), "jaccard-hint")
    sized = sorted(map(tuple, hot.groupBy(F.floor(F.log2("c")).alias("l")).count().collect()), reverse=True)  # 64 rows at most
    least, total = 64, 0
    for level, n in sized:
        if total + n > HINT_MOST:
            break
        least, total = level, total + n
    width = 1 << max(16, (16 * total).bit_length())

    def bitmap(batches) -> Iterator[pa.RecordBatch]:
        working("jaccard")
        out = np.zeros(width, bool)
        for b in batches:
            out[b.column(0).to_numpy() & (width - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())], names=["bits"])

    late = np.zeros(width // 8, np.uint8)
    for r in hot.where(F.floor(F.log2("c")) >= least).select("k").coalesce(8).mapInArrow(bitmap, "bits binary").toLocalIterator():
        late |= np.frombuffer(r[0], np.uint8)
    drop_table(spark, hot)
    return late


def _candidates(spark: SparkSession, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) that join all classes that can be similar: pairs of small runs, stars of large ones.

    The classes of a shingle meet in its bucket; buckets are as many as the prefixes' entries need. A shingle that more than
    RUN classes of one task have is made a star there, and only its least class goes on.
    """
    entries = classes.agg(F.sum(F.length("prefix"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // (8 * BUCKET_TOKENS)))

    def deal(batches) -> Iterator[pa.RecordBatch]:
        working("jaccard")
        held, n, seq = [], 0, 0

        def blocks() -> pa.RecordBatch:
            nonlocal seq
            token = np.concatenate([t for _, _, t in held])
            size = [len(t) for _, _, t in held]
            cls, full = np.repeat([c for c, _, _ in held], size), np.repeat([f for _, f, _ in held], size)
            bucket = (mix(token.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((cls, token, bucket))
            token, cls, full, bucket = token[order], cls[order], full[order], bucket[order]
            first = np.flatnonzero(np.diff(token, prepend=-1))
            length = np.diff(np.append(first, len(token)))
            many = np.repeat(length > RUN, length)
            head = np.zeros(len(token), bool)
            head[first] = True
            full[many] = -1
            star = np.unique(np.stack([np.repeat(cls[first], length)[many], cls[many]], 1), axis=0)
            keep = ~many | head
            token, cls, full, bucket = token[keep], cls[keep], full[keep], bucket[keep]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            got = [(b, 0, token[x:y], cls[x:y], full[x:y]) for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if x < y]
            for i in range(0, len(star), 100_000):
                seq += 1
                got.append((seq % buckets, 1, star[i : i + 100_000, 0], star[i : i + 100_000, 1], np.empty(0)))
            return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int32()), *(pa.array([g[i].astype(kind).tobytes() for g in got], pa.binary()) for i, kind in ((2, "<i8"), (3, "<i8"), (4, "<i4")))], names=["b", "star", "t", "c", "n"])

        for batch in batches:
            for c, f, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.append((c, f, np.frombuffer(raw, "<i8")))
                n += len(held[-1][2])
                if n >= 2_000_000:
                    yield blocks()
                    held, n = [], 0
        if n:
            yield blocks()

    def pair(batches) -> Iterator[pa.RecordBatch]:
        working("jaccard")
        held: dict[int, list] = {}
        for batch in batches:
            for b, star, *raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                t, c, n = (np.frombuffer(r, kind) for r, kind in zip(raw, ("<i8", "<i8", "<i4"), strict=True))
                if star:
                    yield from _edges(t, c, np.full(len(t), -1), np.zeros(len(t), np.int64))
                else:
                    held.setdefault(b, []).append((t, c, n))
        for b in sorted(held):
            token, cls, size = (np.concatenate(x) for x in zip(*held.pop(b), strict=True))
            order = np.lexsort((cls, size, token))
            token, cls, size = token[order], cls[order], size[order].astype(np.int64)
            first = np.flatnonzero(np.diff(token, prepend=-1))
            length = np.diff(np.append(first, len(token)))
            big = (length > RUN) | (size[first] < 0)
            star = np.unique(np.stack([np.repeat(np.minimum.reduceat(cls, first)[big], length[big]), cls[np.repeat(big, length)]], 1), axis=0) if big.any() else np.empty((0, 2), np.int64)
            yield from _edges(star[:, 0], star[:, 1], np.full(len(star), -1), np.zeros(len(star), np.int64))
            a, c, need = [], [], []
            for r in range(2, RUN + 1):
                start = first[(length == r) & ~big]
                for chunk in (start[i : i + 200_000] for i in range(0, len(start), 200_000)):
                    i, j = np.triu_indices(r, 1)
                    x, y = (chunk[:, None] + i).ravel(), (chunk[:, None] + j).ravel()
                    ok = num * size[y] <= den * size[x]  # size[x] <= size[y]
                    x, y = x[ok], y[ok]
                    a.append(np.minimum(cls[x], cls[y]))
                    c.append(np.maximum(cls[x], cls[y]))
                    need.append(np.minimum(shared_least(size[x]), -(-num * size[x] // den)))
            if a:
                a, c, need = np.concatenate(a), np.concatenate(c), np.concatenate(need)
                order = np.lexsort((c, a))
                a, c, need = a[order], c[order], need[order]
                new = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(c, prepend=-1) != 0))
                yield from _edges(a[new], c[new], need[new], np.diff(np.append(new, len(a))))

    dealt = classes.select("cls", "n", "prefix").mapInArrow(deal, "b int, star int, t binary, c binary, n binary").repartitionById(buckets, F.col("b"))
    found = dealt.mapInArrow(pair, "a long, b long, need long, shared long")
    return found.groupBy("a", "b").agg(F.min("need").alias("need"), F.sum("shared").alias("shared")).where("need < 0 or shared >= need").where("a <> b").select("a", "b")


def _edges(a, b, need, shared) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000], pa.int64()) for x in (a, b, need, shared)], names=["a", "b", "need", "shared"])


def _joined(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (cohort, blocks, a, b) of a spanning forest of the links in each block pair of each cohort."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        working("jaccard")
        key, held = None, []

        def close() -> pa.RecordBatch:
            held.sort(key=lambda r: r[0])
            ids = [r[0] for r in held]
            side = np.array([r[2] for r in held]) if key[1] != key[2] else None
            label = tree_links([np.frombuffer(r[1], "<i8") for r in held], side, num, den)
            got = [(key[0], key[3], ids[x], i) for x, i in zip(label.tolist(), ids, strict=True) if ids[x] != i]
            return pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], pa.int64()) for j in range(4)], names=["cohort", "blocks", "a", "b"])

        for batch in batches:
            for *new, cls, tokens, side in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if new != key:
                    if len(held) > 1:
                        yield close()
                    key, held = new, []
                held.append((cls, tokens, side))
        if len(held) > 1:
            yield close()

    order = ["cohort", "i", "j"]
    return sets.repartition(*order).sortWithinPartitions(*order).select(*order, "blocks", "cls", "tokens", "side").mapInArrow(run, "cohort long, blocks long, a long, b long")


def similar_sets(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row, the least id that links of Jaccard similarity >= num/den reach, and content.

    Sets are of the distinct k-word shingles of the whole text, A-Z lower-cased; a text of fewer words is one shingle, a text
    without a word (or null) is empty and linked with nothing. Equal sets are one class and link. Groups of any size are cut
    into blocks; a block pair leaves a forest, never all pairs, and components of groups over one block are found over these
    forests. Classes, not ids, are what is linked: rows that repeat an id are judged each by its own text, and a row with a
    null id links others as any row does; its component_id is null where no linked row has an id. `content` is a 64-bit hash
    of the text. An empty table gives an empty one; other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("content", F.xxhash64("text"))
    hot = spark.sparkContext.broadcast(_hint(spark, rows, k))

    def read(batches) -> Iterator[pa.RecordBatch]:
        working("jaccard")
        late, seen = hot.value, set()
        for batch in batches:
            for row, texts in text_runs(batch, 1):
                out = []
                for s in shingle_sets(texts, k):
                    digest = xxhash.xxh3_128_digest(s.tobytes())
                    prefix = None
                    if len(s) and digest not in seen:
                        if len(seen) >= HELD_DIGESTS:
                            seen.clear()
                        seen.add(digest)
                        at = s & (8 * len(late) - 1)
                        often = (late[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(np.int64)
                        prefix = np.sort(s | often << 62)[: prefix_size(len(s), num, den)].tobytes()
                    out.append((len(s), digest, prefix))
                n, digest, prefix = zip(*out, strict=True)
                some = batch.slice(row, len(out))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(prefix, pa.binary())], names=["doc_id", "content", "n", "digest", "prefix"])

    table = work_table(spark, rows.select("doc_id", "text", "content").mapInArrow(read, "doc_id long, content long, n long, digest binary, prefix binary"), "jaccard-sets")
    total = table.count()
    # a class is known by its own number; its text is read again from one row, named by id and content
    one_row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("own_id"), F.col("content").alias("own_content"))).alias("row")
    classes = table.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.max("prefix").alias("prefix"), one_row)
    classes = work_table(spark, classes.select(F.monotonically_increasing_id().alias("cls"), "digest", "id", "copies", "n", "prefix", "row.own_id", "row.own_content"), "jaccard-classes")
    edges = work_table(spark, _candidates(spark, classes, num, den), "jaccard-edges")
    found = connected_components(spark, edges)
    cohorts = work_table(spark, found, "jaccard-cohorts")
    drop_table(spark, edges, found)

    def sets(batches) -> Iterator[pa.RecordBatch]:
        working("jaccard")
        for batch in batches:
            for row, texts in text_runs(batch, 3, 1_000_000):
                some, got = batch.slice(row, len(texts)), shingle_sets(texts, k)
                out = pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([len(s) for s in got], pa.int64()), pa.array([s.astype("<i8").tobytes() for s in got], pa.binary())], names=["cls", "cohort", "n", "tokens"])
                # texts of one id and one 64-bit hash may still differ
                yield out.filter(pa.array([xxhash.xxh3_128_digest(s.tobytes()) == d for s, d in zip(got, some.column(2).to_pylist(), strict=True)], pa.bool_()))

    # the cohorts grow with the documents, so they are never broadcast: the same plan at every size
    wanted = cohorts.select(F.col("node").alias("cls"), F.col("component").alias("cohort")).join(classes.select("cls", "digest", "own_id", "own_content"), "cls")
    members = rows.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("content") == F.col("own_content"))).select("cls", "cohort", "digest", "text")
    sized = work_table(spark, members.mapInArrow(sets, "cls long, cohort long, n long, tokens binary"), "jaccard-members")
    blocks = sized.groupBy("cohort").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("blocks"), F.count(F.lit(1)).alias("in_cohort"))
    dealt = by_group(sized, blocks, ["cohort"], "in_cohort", sized.count()).withColumn("own", F.pmod(F.xxhash64("cls", F.lit(5)), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("cohort", "blocks", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls", "tokens", (F.col("own") > F.col("other")).cast("int").alias("side"))
    links = work_table(spark, _joined(dealt, num, den), "jaccard-links")
    drop_table(spark, cohorts, sized)
    one = links.where("blocks = 1").select(F.col("b").alias("cls"), F.col("a").alias("component"))
    if links.where("blocks > 1").limit(1).count():
        one = one.union(connected_components(spark, links.where("blocks > 1").select("a", "b")))
    linked = work_table(spark, classes.select("cls", "digest", "id", "copies").join(one.distinct(), "cls", "left").select("digest", "id", "copies", F.coalesce("component", "cls").alias("component")), "jaccard-linked")
    drop_table(spark, classes, links)
    least = linked.groupBy("component").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("in_component")).where("in_component > 1")
    named = by_group(linked, least, ["component"], "in_component", linked.count(), "left").select("digest", "copies", F.coalesce("component_id", "id").alias("component_id"))
    full = by_group(table.select("doc_id", "content", "n", "digest"), named, ["digest"], "copies", total, "left")
    return full.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "content")


def drop_similar(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, of which each component's least id stays; rows with a null id are not dropped.

    Rows are told apart by id and content, so rows that share an id and no text are judged each by its own text.
    """
    found = similar_sets(docs, k, num, den, id_col, text_col).where("component_id <> doc_id").select("doc_id", "content").distinct()
    own = (docs[id_col] == found["doc_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == found["content"])
    return docs.join(found.hint("merge"), own, "left_anti").select(*(docs[c] for c in docs.columns))
