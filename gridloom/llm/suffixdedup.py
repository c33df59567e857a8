"""Suffix-array dedup: removes bytes covered by 200-byte strings that start more than once.

Every window of 200 bytes is assigned to its minimiser, the smallest hash of its
50-byte substrings, so equal windows meet under one key.  Consecutive windows of
one document with one minimiser form a context.  Keys that occur once are
dropped; equal contexts become one with a multiplicity; what is left is sorted
by column-wise construction of the collection's Burrows-Wheeler transform: each
round every context inserts its next symbol, from its end to its start, and the
order and the common prefixes of all suffixes inserted so far are updated in one
sequential pass.  A window is repeated if its suffix shares 200 bytes with a
neighbour in the final order, or if its context has a multiplicity above one.

A task builds one collection of at most CHUNK bytes at a time, of whole keys.
Keys with more than HOT_CONTEXTS different contexts are spread instead: their
windows are counted by 128-bit hash, which aggregates before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.runtime import scratch_dir, written

from .common import arrow_map, extra_columns, pieces

LENGTH, GRAM = 200, 50
#: A window holds its minimiser with between 0 and LENGTH - GRAM bytes on its left: classes of windows by these, and the bytes
#: on the left and right of the gram that all windows of a class hold.
CLASSES = ((0, 37), (37, 75), (75, 112), (112, LENGTH - GRAM + 1))
SIDES = tuple((lo, LENGTH - GRAM - hi + 1) for lo, hi in CLASSES)
#: Bytes of contexts that one construction sorts, and contexts of a key beyond which its windows are counted instead.
CHUNK, HOT_CONTEXTS = 50_000, 20_000
#: Windows of a text, and about as many bytes, whose minimisers are found at once; low bits of a hash that hold a place among them.
BLOCK = 1 << 16
_POS = np.uint64((1 << 18) - 1)
#: The part of a suffix's number that holds a rank; the rest is its first symbol.
_RANK = np.uint32(2**24 - 1)


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, and a random value a byte."""

    def __init__(self, base: int, seed: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.values = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, self.base))))
            self.down = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, self.inverse))))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self.upto(len(data) + 1)
        return np.concatenate(([np.uint64(0)], np.cumsum(self.values[data] * self.up[: len(data)], dtype=np.uint64)))

    def each(self, sums: np.ndarray, size: int) -> np.ndarray:
        """Hashes of all stretches of a size."""
        n = len(sums) - size
        return self._mixed((sums[size:] - sums[:n]) * self.down[:n])

    def of(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the stretches [start, stop), whatever their place."""
        return self._mixed((sums[stop] - sums[start]) * self.down[start])

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(32))


_HASHES = (Powers(0x5851F42D4C957F2D, 1), Powers(0x27BB2EE687B0B0FD, 2))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.uint64(2**64 - 1))
    padded[:n] = x
    rows = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def contexts(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text index, first window, number of windows, bytes before the gram, key, content hash, and the classes' hashes in two numbers) of every context.

    Longer texts are cut into blocks that overlap by less than a window, so that
    every window is in one block and has the minimiser that it has in the text; a
    context that goes on in the next block becomes two of the same key.
    """
    found, names, begins, blocks, size = [], [], [], [], 0

    def flush() -> None:
        owner, first, *rest = _contexts_of_blocks(blocks)
        found.append((np.array(names, np.int64)[owner], first + np.array(begins, np.int64)[owner], *rest))

    for i, text in enumerate(texts):
        for b in range(0, len(text) - LENGTH + 1, BLOCK):
            names.append(i)
            begins.append(b)
            blocks.append(text[b : b + BLOCK + LENGTH - 1])
            size += len(blocks[-1])
            if size >= BLOCK:
                flush()
                names, begins, blocks, size = [], [], [], 0
    if blocks or not found:
        flush()
    return tuple(np.concatenate(column) for column in zip(*found, strict=True))


def _contexts_of_blocks(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """The same of texts whose places all fit in the low bits of a hash.

    Windows of one class hold the minimiser with the same bytes round it, so they
    can only be repeated if this stretch is; each class has 32 bits of its hash.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    none = tuple(np.empty(0, np.int64) for _ in range(8))
    if len(data) < LENGTH:
        return none
    if len(data) > int(_POS):
        raise ValueError("more bytes than places")
    sums = [p.sums(data) for p in _HASHES]
    at = np.arange(len(data) - GRAM + 1)
    grams = _HASHES[0].each(sums[0], GRAM)
    # the order is by hash, then leftmost: the low bits hold the place
    low = sliding_min((grams & ~_POS) | at.astype(np.uint64), LENGTH - GRAM + 1) & _POS
    start = np.arange(len(data) - LENGTH + 1)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[: len(start)]
    inside = np.flatnonzero(start + LENGTH <= ends[owner])
    start, owner, low = inside, owner[inside], low[inside].astype(np.int64)
    if not len(start):
        return none
    first = np.ones(len(start), bool)
    first[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
    f = np.flatnonzero(first)
    count = np.diff(np.append(f, len(start)))
    a = start[f]
    stop = a + count - 1 + LENGTH
    content = _HASHES[0].of(sums[0], a, stop) + np.uint64(0xC2B2AE3D27D4EB4F) * _HASHES[1].of(sums[1], a, stop) + count.astype(np.uint64)
    begins = np.concatenate(([0], ends[:-1]))
    m = low[f]
    lead, marks = m - a, []
    for (lo, hi), (before, after) in zip(CLASSES, SIDES, strict=True):
        has = has_class(lead, count, lo, hi)
        mark = content >> np.uint64(32)
        mark[has] = _HASHES[1].of(sums[1], m[has] - before, m[has] + GRAM + after) >> np.uint64(32)
        marks.append(mark)
    two = [(marks[i] << np.uint64(32) | marks[i + 1]).view(np.int64) for i in (0, 2)]
    return owner[f], a - begins[owner[f]], count, lead, grams[m].view(np.int64), content.view(np.int64), *two


def has_class(lead, count, lo: int, hi: int):
    """Whether a context has windows with at least ``lo`` and fewer than ``hi`` bytes before the gram."""
    return (lead >= lo) & (lead - count + 1 < hi)


def column_bwt(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of all suffixes of a collection, built column by column from the strings' ends.

    Returns (tail, common, last): for each suffix in order the rank of the suffix
    that follows its first symbol, the common prefix with the one before (at most
    LENGTH), and for each string the rank of the whole string.
    """
    n = len(strings)
    size = np.array([len(s) for s in strings], np.int64)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    stop = np.cumsum(size)
    by_size = np.argsort(-size, kind="stable")
    many = len(strings) - np.searchsorted(size[by_size][::-1], np.arange(int(size.max(initial=0))), "right")
    # first symbol and rank of the tail of each suffix in one number; the empty suffixes come first
    if n + int(size.sum()) > _RANK:
        raise ValueError("more suffixes than ranks")
    key = np.zeros(n, np.uint32)
    common = np.zeros(n, np.uint8)
    place = np.arange(n, dtype=np.int64)  # rank of each string's latest suffix
    for j in range(len(many)):
        live = by_size[: many[j]]
        own = ((flat[stop[live] - 1 - j].astype(np.int64) << 24) | place[live]).astype(np.uint32)
        order = np.argsort(own)
        live, own = live[order], own[order]
        m, old = len(live), len(key)
        new = n + np.searchsorted(key[n:], own) + np.arange(m)
        kept = np.ones(old + m, bool)
        kept[new] = False
        shift = np.flatnonzero(kept)  # where the old suffixes go
        merged, shared = np.empty(old + m, np.uint32), np.zeros(old + m, np.uint8)
        merged[new], merged[kept] = own, key
        shared[kept] = common
        # only a new suffix and the one after it have a new neighbour
        check = np.unique(np.concatenate((new, new[new + 1 < old + m] + 1)))
        left, right = merged[check - 1], merged[check]
        same = (left >> 24 == right >> 24) & (check > n)
        shared[check[~same]] = 0
        check = check[same]
        if len(check):
            lo, hi = (left[same] & _RANK).astype(np.int64) + 1, (right[same] & _RANK).astype(np.int64) + 1
            by = np.argsort(lo, kind="stable")
            pairs = np.empty(2 * len(check), np.int64)
            pairs[::2], pairs[1::2] = lo[by], hi[by]
            least = np.minimum.reduceat(np.append(common, np.uint8(0)), pairs)[::2]
            shared[check[by]] = np.minimum(least, LENGTH - 1) + 1
        # tails were ranks before this round
        filled = merged[n:]
        merged[n:] = (filled & ~_RANK) | shift.astype(np.uint32)[filled & _RANK]
        key, common = merged, shared
        place = shift[place]
        place[live] = new
    return (key & _RANK).astype(np.int64), common, place


def repeated_windows(strings: list[bytes], many: np.ndarray) -> list[tuple[int, int, int]]:
    """(string, first window, end) of maximal runs of windows that start more than once in the collection."""
    tail, common, rank = column_bwt(strings)
    twice = common >= LENGTH
    twice[:-1] |= twice[1:].copy()
    windows = np.array([len(s) - LENGTH + 1 for s in strings])
    hit = np.zeros((len(strings), int(windows.max(initial=0)) + 2), np.int8)
    for k in range(int(windows.max(initial=0))):
        live = np.flatnonzero(windows > k)
        hit[live, k + 1] = twice[rank[live]] | many[live]
        rank[live] = tail[rank[live]]
    step = np.diff(hit, axis=1)
    s, a = np.nonzero(step == 1)
    _, b = np.nonzero(step == -1)
    return list(zip(s.tolist(), a.tolist(), b.tolist(), strict=True))


def _occurrences(src: DataFrame, marks: bool = False) -> DataFrame:
    """(id, at, key, content) of every context, and with ``marks`` the classes' hashes.  ``at`` is the first window, then 8 bits for the number of windows and 8 for the bytes before the gram."""
    names = ["id", "at", "key", "content", *(["m01", "m23"] if marks else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 256):
                texts = [x or b"" for x in batch.column(1).cast(pa.large_binary()).to_pylist()]
                owner, first, count, lead, *rest = contexts(texts)
                if len(owner):
                    found = [first << 16 | count << 8 | lead, *rest][: len(names) - 1]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *(pa.array(x, pa.int64()) for x in found)], names=names)

    return arrow_map(src.select("id", "text"), run, ", ".join(f"{n} bigint" for n in names))


def _unpacked(df: DataFrame) -> DataFrame:
    return df.withColumns({"a": F.shiftright("at", 16), "n": F.shiftright("at", 8).bitwiseAND(255).cast("int"), "lead": F.col("at").bitwiseAND(255).cast("int")}).drop("at")


def _shared_part(stands: DataFrame) -> DataFrame:
    """Contexts of which another of the key shares a class, cut to the windows of such classes: ``a`` and ``n`` are those of the cut, ``skip`` the windows before it."""
    c = F.col
    mark = [F.shiftright("m01", 32), c("m01").bitwiseAND((1 << 32) - 1), F.shiftright("m23", 32), c("m23").bitwiseAND((1 << 32) - 1)]
    out = stands.repartition("key").withColumns({f"_m{i}": m for i, m in enumerate(mark)})
    for i, (lo, hi) in enumerate(CLASSES):
        out = out.withColumn(f"_s{i}", has_class(c("lead"), c("n"), lo, hi) & (F.count("*").over(Window.partitionBy("key", f"_m{i}")) > 1))
    low = F.coalesce(*[F.when(c(f"_s{i}"), lo) for i, (lo, _) in enumerate(CLASSES)])
    high = F.coalesce(*[F.when(c(f"_s{i}"), hi - 1) for i, (_, hi) in reversed([*enumerate(CLASSES)])])
    # the first window has the most bytes before the gram
    out = out.where(low.isNotNull()).withColumns({"_from": F.least(high, c("lead")), "_to": F.greatest(low, c("lead") - c("n") + 1)})
    skip = c("lead") - c("_from")
    return out.select("id", (c("a") + skip).alias("a"), (c("_from") - c("_to") + 1).cast("int").alias("n"), skip.cast("int").alias("skip"), "key", "content", "many", "classes")


def _cut_out(src: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, content, skip, many, hot, bytes) of the wanted parts of contexts: (id, a, n, skip, key, content, many, hot)."""
    lists = wanted.groupBy("id").agg(F.collect_list(F.struct("key", "content", "skip", "many", "hot", "a", "n")).alias("wanted"))
    names = ["key", "content", "skip", "many", "hot"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 128):
                rows = []
                for text, lst in zip(batch.column(0).cast(pa.large_binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    rows += [(*[w[x] for x in names], text[w["a"] : w["a"] + w["n"] - 1 + LENGTH]) for w in lst]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[*names, "bytes"])

    return arrow_map(src.join(lists, "id").select("text", "wanted"), run, "key bigint, content bigint, skip int, many boolean, hot boolean, bytes binary")


_HITS = "key bigint, content bigint, start int, end int"


def _sorted_hits(rows: DataFrame) -> DataFrame:
    """Runs of repeated windows of contexts that come by whole keys, sorted by key in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, contents, skips, many, data, size = [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            hits = repeated_windows(data, np.array(many, bool)) if data else []
            cols = [[keys[s] for s, _, _ in hits], [contents[s] for s, _, _ in hits], [a + skips[s] for s, a, _ in hits], [b + skips[s] for s, _, b in hits]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["key", "content", "start", "end"])

        for whole in batches:
            for batch in pieces(whole, 2000):
                for key, content, skip, m, b in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    if size >= CHUNK and key != keys[-1]:
                        yield flush()
                        keys, contents, skips, many, data, size = [], [], [], [], [], 0
                    keys.append(key)
                    contents.append(content)
                    skips.append(skip)
                    many.append(m)
                    data.append(b)
                    size += len(b)
        yield flush()

    return arrow_map(rows.select("key", "content", "skip", "many", "bytes"), run, _HITS)


def _counted_hits(rows: DataFrame) -> DataFrame:
    """The same for keys with very many contexts, by counting their windows' hashes."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 500):
                out = [(hashlib.blake2b(b[k : k + LENGTH], digest_size=16).digest(), key, content, k + skip, m) for key, content, skip, m, b in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True) for k in range(len(b) - LENGTH + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()), strict=True)], names=["window", "key", "content", "k", "many"])

    w = arrow_map(rows.select("key", "content", "skip", "many", "bytes"), windows, "window binary, key bigint, content bigint, k int, many boolean")
    twice = w.groupBy("window").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("n")).where("n > 1").select("window")
    return w.join(twice, "window", "left_semi").select("key", "content", F.col("k").alias("start"), (F.col("k") + 1).alias("end"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """One row per document: id, n_bytes (long), spans array<struct<start,end>> of removed bytes, kept binary.

    Null text is empty.  Every row counts as a document of its own, whatever its
    id: null and repeated ids are returned as they are, with their own text's
    spans, and repeated rows repeat each other and lose all their windows.
    Texts under 200 bytes lose nothing; an empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    path = scratch_dir(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    # rows get numbers of their own, which hold once they are written
    src = extra_columns(docs, [id_col, text_col]).select(F.monotonically_increasing_id().alias("id"), F.col(f"`{id_col}`").alias("own"), F.col(f"`{text_col}`").alias("text"))
    src = written(src, f"{path}/rows")
    # counts are partial before each shuffle, so a key or context that fills much of the corpus is one row a task
    same = _occurrences(src).groupBy("key", "content").agg(F.count("*").alias("times"), F.min("id").alias("first"))
    by_key = Window.partitionBy("key")
    same = same.withColumn("all", F.sum("times").over(by_key)).withColumn("classes", F.count("*").over(by_key)).where("all > 1")
    same = written(same.select("key", "content", (F.col("times") > 1).alias("many"), "first", "classes"), f"{path}/classes")
    occ = written(_occurrences(src, marks=True).join(same, ["key", "content"]), f"{path}/occurrences")
    stands = occ.where((F.col("classes") > 1) & (F.col("id") == F.col("first"))).groupBy("key", "content").agg(F.min("at").alias("at"), *[F.first(c).alias(c) for c in ("id", "many", "classes", "m01", "m23")])
    wanted = _shared_part(_unpacked(stands)).withColumn("hot", F.col("classes") > hot_contexts)
    occ = _unpacked(occ)
    texts = written(_cut_out(src, wanted), f"{path}/contexts")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-texts.count() // 15_000))
    hits = _sorted_hits(texts.where("not hot").repartition(parts, "key").sortWithinPartitions("key", "content"))
    hits = hits.unionByName(_counted_hits(texts.where("hot")))
    # a context that occurs again is repeated as a whole; of the others the sort tells which windows are
    spans = occ.where("not many").join(hits, ["key", "content"]).select("id", (F.col("a") + F.col("start")).alias("start"), (F.col("a") + F.col("end") - 1 + LENGTH).alias("end"))
    spans = spans.unionByName(occ.where("many").select("id", F.col("a").alias("start"), (F.col("a") + F.col("n") - 1 + LENGTH).alias("end")))
    spans = written(spans.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans")), f"{path}/spans")
    joined = src.join(spans, "id", "left").select("own", "text", "spans")
    names = [id_col, "n_bytes", "spans", "kept"]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                texts = [x or b"" for x in batch.column(1).cast(pa.large_binary()).to_pylist()]
                cuts, kept = [], []
                for text, lst in zip(texts, batch.column(2).to_pylist(), strict=True):
                    runs: list[list[int]] = []
                    for s, e in sorted((x["start"], x["end"]) for x in lst or ()):
                        if runs and s <= runs[-1][1]:
                            runs[-1][1] = max(e, runs[-1][1])
                        else:
                            runs.append([s, e])
                    cuts.append([{"start": s, "end": e} for s, e in runs])
                    marks = [0, *(x for r in runs for x in r), len(text)]
                    kept.append(b"".join(text[marks[i] : marks[i + 1]] for i in range(0, len(marks), 2)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(cuts, span), pa.array(kept, pa.binary())], names=names)

    return arrow_map(joined, run, f"`{id_col}` {kind}, n_bytes bigint, spans array<struct<start:int,end:int>>, kept binary")
