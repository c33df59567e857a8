"""N-gram Jaccard join by prefix filters under several global token orders.

Documents become sets of 64-bit hashes of their 5-word shingles, of which 48 bits
are stored and compared; sets equal in all 128 bits of a digest are one node from
the start.  If two sets link at Jaccard similarity 0.75, their
prefixes (all but 75 % of the set, plus one) share a computable number of tokens
under any global order.  The first order goes by document frequency, as counted
over all documents in a sketch of fixed width, then by hash: what many documents
share comes last and leaves the prefixes.  It makes the candidates through an
equi-join on prefix tokens.  The prefixes under two more, independent orders are
then compared, and only candidates that pass all three filters have their full
sets moved and compared.

Only connection is asked for, so buckets are not expanded to all pairs: round by
round, a few leaders of each bucket are compared with its members, what links is
merged, and only members of different components meet again, until every bucket
is exhausted: at the latest when those outside of each bucket's largest component
are few enough to be compared with all its members at once.  Orders and sketch
are a matter of speed alone: no link is lost.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.components import connected_components
from gridloom.runtime import dropped, scratch_dir, written

from .common import arrow_map, extra_columns, pack, pack_ints, pieces, unpack, unpack_ints

SHINGLE = 5
#: Counters of the document-frequency sketch (one byte each when broadcast) and the slices it is merged in.
SLOTS, SLICES = 1 << 22, 16
#: Leaders a bucket in each round (then 16 times as many each), the size up to which a bucket is exhausted at once,
#: and the pairs of a member outside its bucket's largest component and any member, in all buckets that are left, up to which these are exhausted in one round.
LEADERS, SMALL_BUCKET, AT_ONCE = (1, 16, 256, 4096), 8, 5e7
#: Members of one leader that a task compares.
MEMBERS = 512
#: Most node numbers (8 bytes each) and pairs of them (25 bytes a row, two rows at most) that are broadcast to pick sets by; more go through a shuffled join.
BROADCAST_NODES, BROADCAST_PAIRS = 1_000_000, 200_000
#: Prefix tokens of a packed row set and of a task that looks for common ones, and the largest bucket that such a task may hold.
CHUNK_TOKENS, PARTITION_TOKENS, HOT_BUCKET = 300_000, 1_000_000, 65_536
#: Set hashes that a task remembers to store a repeated set once.
SEEN = 100_000
#: Bytes whose words are hashed at once.
BLOCK = 1 << 18
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
_BASE, _INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
_VALUES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_IS_SPACE = np.array([i in b" \t\n\x0b\x0c\r" for i in range(256)])
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK + 1)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, np.uint64(b))))) for b in (_BASE, _INVERSE)]
    return _POWERS


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[0]
    return h ^ (h >> np.uint64(29))


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first places of the words in a block; a word beyond 256 bytes is hashed by itself."""
    a = np.frombuffer(data, np.uint8)
    word = np.zeros(len(a) + 2, np.int8)
    word[1:-1] = ~_IS_SPACE[a]
    edge = np.flatnonzero(np.diff(word))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start
    up, down = _powers(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_VALUES[a] * up[: len(a)], out=sums[1:])
    h = _mixed((sums[stop] - sums[start]) * down[start])
    for k in np.flatnonzero(stop - start > 256):
        h[k] = xxhash.xxh3_64_intdigest(data[start[k] : stop[k]])
    return h, start


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, A-Z in lower case, and how many each text has."""
    counts = np.zeros(len(texts), np.int64)
    found: list[np.ndarray] = []
    block: list[bytes] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        begins = np.cumsum([0, *(len(b) + 1 for b in block)])
        h, start = _hashed(b" ".join(block).lower())
        found.append(h)
        np.add.at(counts, np.array(owners, np.int64)[np.searchsorted(begins, start, "right") - 1], 1)
        block.clear()
        owners.clear()
        size = 0

    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            stop = len(text)
            if stop - at > BLOCK:  # cut at a space; a word longer than a block stays whole
                gap = _SPACE.search(text, at + BLOCK)
                stop = gap.start() if gap else stop
            block.append(text[at:stop])
            owners.append(k)
            size += stop - at
            at = stop
            if size >= BLOCK:
                flush()
    if block:
        flush()
    return np.concatenate([*found, np.empty(0, np.uint64)]), counts


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than ``k`` words are one shingle, none give none."""
    w, counts = word_hashes(texts)
    h = w.copy()
    if len(w) >= k:
        n = len(w) - k + 1
        h = w[:n]
        for j in range(1, k):
            h = _mixed(h) + w[j : j + n]
        h = _mixed(h)
    out, at = [], 0
    for c in counts.tolist():
        if c >= k:
            s = np.sort(h[at : at + c - k + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif c:
            out.append(np.array([xxhash.xxh3_64_intdigest(w[at : at + c].tobytes(), seed=c)], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out


def pack_tokens(s: np.ndarray) -> bytes:
    """Six bytes a token: the upper 32 bits of all, then 16 more."""
    return (s >> np.uint64(32)).astype(np.uint32).tobytes() + (s >> np.uint64(16)).astype(np.uint16).tobytes()


def unpack_tokens(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    return (np.frombuffer(raw, np.uint32, n).astype(np.uint64) << np.uint64(16)) | np.frombuffer(raw, np.uint16, n, 4 * n)


def prefix_length(n: int) -> int:
    """Tokens of a set of n that must hold one of any partner's under 100 * |intersection| >= 75 * |union|."""
    return n - (3 * n + 3) // 4 + 1


def least_shared(na: int, nb: int) -> int:
    """Tokens that the prefixes of two linked sets share at least: beyond the prefix of the larger lie at most ceil(0.75 n) - 1 common ones."""
    return (3 * (na + nb) + 6) // 7 - ((3 * max(na, nb) + 3) // 4 - 1)


def later_prefixes(s: np.ndarray) -> list[bytes]:
    """The prefixes of a set under the second and the third order, in 32 bits a token."""
    p, out = prefix_length(len(s)), []
    for m in _MIX[1:]:
        x = s * m
        first = np.partition(x, p - 1)[:p] if p < len(x) else x
        out.append((first >> np.uint64(32)).astype(np.uint32).tobytes())
    return out


def prefixes_meet(a: list[np.ndarray], b: list[np.ndarray], na: int, nb: int) -> bool:
    """Whether both later prefixes of two sets share enough tokens; equal 32 bits may let too many pass, never too few."""
    need = least_shared(na, nb)
    return all(int(np.isin(x, y).sum()) >= need for x, y in zip(a, b, strict=True))


def links(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets link."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def slots(tokens: np.ndarray) -> np.ndarray:
    """The counters of tokens, by their lower bits."""
    return tokens & np.uint64(SLOTS - 1)


def packed_counts(c: np.ndarray) -> bytes:
    """Counters in a byte each, then place and value of those that need more."""
    large = np.flatnonzero(c >= 255)
    low = pack(np.minimum(c, 255).astype(np.uint8))
    return len(low).to_bytes(4, "little") + low + pack(np.stack([large, c[large].astype(np.int64)]))


def add_counts(total: np.ndarray, raw: bytes) -> None:
    n = 4 + int.from_bytes(raw[:4], "little")
    part = unpack(raw[4:n], np.uint8).astype(np.int64)
    place, value = unpack(raw[n:], np.int64).reshape(2, -1)
    part[place] = value
    total += part


def set_rows(src: DataFrame, seed: int = 0) -> DataFrame:
    """One row a document: id, n, node and proof (128 bits of its set's hash), tokens; and, by slice, the task's counts of tokens.

    A task stores the tokens of a repeated set once and counts it once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, kind = np.zeros(SLOTS, np.uint32), set(), None
        names = ["id", "n", "node", "proof", "tokens", "slice", "counts"]
        for whole in batches:
            kind = whole.schema.types[0]
            for batch in pieces(whole, 256):
                sets = shingle_sets([x or b"" for x in batch.column(1).cast(pa.large_binary()).to_pylist()])
                nodes, proofs, tokens, new = [], [], [], []
                for s in sets:
                    if not len(s):
                        nodes.append(None)
                        proofs.append(None)
                        tokens.append(None)
                        continue
                    raw = s.tobytes()
                    d = hashlib.blake2b(raw, digest_size=16, salt=seed.to_bytes(8, "little")).digest()
                    node = int.from_bytes(d[:8], "little", signed=True)
                    nodes.append(node)
                    proofs.append(int.from_bytes(d[8:], "little", signed=True))
                    tokens.append(None if d in seen else pack_tokens(s))
                    if d not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(d)
                        new.append(s)
                if new:
                    np.add.at(total, slots(np.concatenate(new) >> np.uint64(16)), 1)
                none = pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(proofs, pa.int64()), pa.array(tokens, pa.binary()), *none], names=names)
        width = SLOTS // SLICES
        some = [s for s in range(SLICES) if total[s * width : (s + 1) * width].any()]
        if some:
            packed = [packed_counts(total[s * width : (s + 1) * width]) for s in some]
            none = [pa.nulls(len(some), t) for t in (kind, pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(some, pa.int32()), pa.array(packed, pa.binary())], names=names)

    return arrow_map(src, run, f"id {src.schema['id'].dataType.simpleString()}, n bigint, node bigint, proof bigint, tokens binary, slice int, counts binary")


def frequency_classes(rows: DataFrame) -> bytes:
    """The merged sketch as one byte a counter, an eighth of an octave each: SLOTS bytes, whatever the corpus.

    A token's counter is at least its document frequency.  Tasks' counters are
    summed slice by slice as a stream.
    """
    width = SLOTS // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for whole in batches:
            for batch in pieces(whole, 16):
                for s, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if s not in total:
                        total[s] = np.zeros(width, np.int64)
                    add_counts(total[s], raw)
        for s, c in total.items():
            code = np.minimum(np.floor(8 * np.log2(np.maximum(c, 1))), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([code.tobytes()], pa.binary())], names=["slice", "code"])

    merged = arrow_map(rows.where("slice is not null").select("slice", "counts").repartition("slice"), run, "slice int, code binary")
    out = np.zeros(SLOTS, np.uint8)
    for s, code in merged.collect():  # at most SLOTS bytes; an iterator runs a job a partition, most of them empty
        out[s * width : (s + 1) * width] = np.frombuffer(code, np.uint8)
    return out.tobytes()


def prefix_tokens(sets: DataFrame, classes: bytes, parts: int, hot: int) -> DataFrame:
    """Packed prefix tokens under the first order, by range of the token: a row holds those of some documents in one range.

    Tokens whose counter exceeds the class ``hot`` travel in rows of
    their own.
    """
    shared = sets.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = np.frombuffer(shared.value, np.uint8)
        nodes: list[int] = []
        cold_t, cold_o, hot_t, hot_o, n = [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            own = np.array(nodes, np.int64)
            for is_hot, ts, os in ((False, cold_t, cold_o), (True, hot_t, hot_o)):
                t = np.concatenate([*ts, np.empty(0, np.uint64)])
                if not len(t):
                    continue
                order = np.argsort(t)
                t, o = t[order], np.concatenate(os)[order]
                edges = np.searchsorted(((t >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1))
                out = []
                for q in range(parts):
                    x, y = edges[q], edges[q + 1]
                    if x < y:
                        owners, at = np.unique(o[x:y], return_inverse=True)
                        out.append((q, is_hot, pack_ints(np.diff(t[x:y].astype(np.int64), prepend=0)), pack(own[owners]), pack_ints(at)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.bool_(), *[pa.binary()] * 3), strict=True)], names=["p", "hot", "tokens", "nodes", "owners"])

        for whole in batches:
            for batch in pieces(whole, 256):
                for node, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    s = unpack_tokens(raw)
                    c = code[slots(s)]
                    first = np.argsort(c, kind="stable")[: prefix_length(len(s))]
                    c = c[first]
                    for ts, os, mask in ((cold_t, cold_o, c <= hot), (hot_t, hot_o, c > hot)):
                        ts.append(s[first[mask]])
                        os.append(np.full(len(ts[-1]), len(nodes)))
                    nodes.append(node)
                    n += len(first)
                if n >= CHUNK_TOKENS:
                    yield from flush()
                    for x in (nodes, cold_t, cold_o, hot_t, hot_o):
                        x.clear()
                    n = 0
        yield from flush()

    return arrow_map(sets.select("node", "tokens"), run, "p int, hot boolean, tokens binary, nodes binary, owners binary")


def met_tokens(packed: DataFrame, parts: int) -> DataFrame:
    """(token, node, size) of the tokens in the prefixes of two sets or more; size is null for hot ones, which pass as they come."""
    kinds = [pa.int64(), pa.int64(), pa.int64()]
    names = ["token", "node", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ts, ns = [], []
        for whole in batches:
            for batch in pieces(whole, 64):
                for is_hot, tokens, nodes, owners in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                    t, n = np.cumsum(unpack_ints(tokens)), unpack(nodes, np.int64)[unpack_ints(owners)]
                    if is_hot:
                        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n), pa.nulls(len(t), pa.int64())], names=names)
                    else:
                        ts.append(t)
                        ns.append(n)
        if ts:
            t, n = np.concatenate(ts), np.concatenate(ns)
            del ts, ns
            order = np.argsort(t)
            t, n = t[order], n[order]
            twice = np.zeros(len(t) + 1, bool)
            twice[1:-1] = t[1:] == t[:-1]
            kept = twice[1:] | twice[:-1]
            t, n = t[kept], n[kept]
            order = np.lexsort((n, t))
            t, n = t[order], n[order]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (n[1:] != n[:-1])
            t, n = t[new], n[new]
            _, at, size = np.unique(t, return_inverse=True, return_counts=True)
            size = size[at]
            for k in range(0, len(t), 100_000):
                s = slice(k, k + 100_000)
                many = size[s] > 1
                yield pa.RecordBatch.from_arrays([pa.array(x[s][many], y) for x, y in zip((t, n, size), kinds, strict=True)], names=names)

    return arrow_map(packed.repartition(parts, "p"), run, "token bigint, node bigint, size bigint")


def picked(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row a node of ``nodes``, a written table, with its set and its later prefixes; few nodes are broadcast, counted by their bytes."""
    few = nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    rows = sets.join(F.broadcast(nodes) if few else nodes, "node", "left_semi").select("node", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 256):
                later = [later_prefixes(unpack_tokens(x)) for x in batch.column(1).to_pylist()]
                n = [len(x) // 6 for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array([x[0] for x in later], pa.binary()), pa.array([x[1] for x in later], pa.binary()), batch.column(1)], names=["node", "n", "second", "third", "tokens"])

    return arrow_map(rows, run, "node bigint, n int, second binary, third binary, tokens binary").dropDuplicates(["node"])


def _dealt(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (a, b, *columns of b) by leader ``a``, its own row first; the members of one leader are dealt in groups of about MEMBERS."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("groups"))
    rows = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("deal"), F.lit(True).alias("member"))
    own = rows.select("a", F.col("a").alias("b"), "deal", F.lit(False).alias("member")).distinct()
    rows = rows.unionByName(own)
    few = pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    rows = sets.select(F.col("node").alias("b"), *columns).join(F.broadcast(rows) if few else rows, "b")
    return rows.repartition("a", "deal").sortWithinPartitions("a", "deal", "member").select("a", "b", "member", *columns)


def _passing(rows: DataFrame, read, test) -> DataFrame:
    """(a, b) of the members that pass the test against their leader, which comes before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for whole in batches:
            for batch in pieces(whole, 256):
                found_a, found_b = [], []
                for a, b, member, *rest in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                    x = read(*rest)
                    if not member:
                        own = x
                    elif test(own, x):
                        found_a.append(a)
                        found_b.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return arrow_map(rows, run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame, path: str) -> DataFrame:
    """The pairs that link: first the prefixes under the two later orders are compared, then the sets of what passed."""
    short = lambda x: np.frombuffer(x, np.uint32)
    near = _passing(_dealt(pairs, sets, ["n", "second", "third"]), lambda n, x, y: (n, [short(x), short(y)]), lambda x, y: prefixes_meet(x[1], y[1], x[0], y[0]))
    near = written(near, f"{path}-near")
    return _passing(_dealt(near, sets, ["tokens"]), unpack_tokens, links)


def _need(na: Column, nb: Column) -> Column:
    """least_shared as a column expression in whole numbers."""
    return F.floor((3 * (na + nb) + 6) / 7) - (F.floor((3 * F.greatest(na, nb) + 3) / 4) - 1)


def _open(leaders: int) -> Column:
    return F.sum(((F.col("size") > SMALL_BUCKET) & (F.col("size") > leaders)).cast("int"))


def _bits(high: bool) -> Column:
    """Of a node's 128 bits one half, with the bit of each of its tokens set."""
    return F.bit_or(F.expr(f"case when (token & 64) = {64 * high} then shiftleft(1L, cast(token & 63 as int)) else 0L end"))


def _most_shared(x: str, y: str) -> Column:
    """Tokens of x that y can hold at most: each bit that y has not stands for one at least that it does not hold."""
    missing = [F.bit_count(F.col(f"{half}_{x}").bitwiseAND(F.bitwise_not(F.col(f"{half}_{y}")))) for half in ("low", "high")]
    return F.col(f"kept_{x}") - missing[0] - missing[1]


def cross_pairs(rows: DataFrame, leaders: int | None) -> DataFrame:
    """Pairs (a, b) of one bucket and different components, within reach in size, that may share enough prefix tokens.

    ``rows`` hold all buckets in which such a pair can meet; ``kept`` is how many
    of them a node is in, ``open`` how many of these are not exhausted by now,
    ``low`` and ``high`` a bit for each of its tokens (``_bits``, or 0).
    Without a number of leaders all buckets are exhausted: whoever is outside of
    ``main``, the bucket's largest component, leads, as no such pair is within it.
    """
    side = lambda df, k: df.select("token", *[F.col(c).alias(c + k) for c in ("node", "n", "rank", "component", "main", "kept", "open", "low", "high")])
    ordered = F.col("rank_a") < F.col("rank_b")
    if leaders is None:
        leads, ordered = F.col("component") != F.col("main"), ordered | (F.col("component_b") == F.col("main_b"))
    else:
        leads = (F.col("size") <= SMALL_BUCKET) | (F.col("rank") <= leaders)
    lead, rest = side(rows.where(leads), "_a"), side(rows, "_b")
    need = _need(F.col("n_a"), F.col("n_b"))
    near = ordered & (F.col("component_a") != F.col("component_b")) & (4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b")) & (_most_shared("a", "b") >= need) & (_most_shared("b", "a") >= need)
    pairs = lead.join(rest.withColumnRenamed("token", "token_b"), (F.col("token") == F.col("token_b")) & near)
    pairs = pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"), need.alias("need"), F.least("open_a", "open_b").alias("open"))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("need").alias("need"), F.max("open").alias("open"))
    return pairs.where(F.col("shared") + F.col("open") >= F.col("need")).select("a", "b")


def stored_sets(src: DataFrame, path: str) -> tuple[DataFrame, DataFrame, str]:
    """The written rows of ``set_rows``, (node, rep), each distinct set with its smallest id, and where the rows are.

    Should two different sets get one 64-bit node, their proofs differ and all is hashed anew.
    """
    for seed in range(1 << 16):
        rows = written(set_rows(src, seed), f"{path}/sets{seed}")
        known = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("rep"), F.min("proof").alias("lo"), F.max("proof").alias("hi"))
        known = written(known, f"{path}/nodes{seed}")
        if known.where("lo <> hi").isEmpty():
            return rows, known.select("node", "rep"), f"{path}/sets{seed}"
        dropped(src.sparkSession, f"{path}/sets{seed}")
    raise RuntimeError("no seed tells all sets apart")


def link_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles (long) and component_id, the smallest id reachable by links.

    The id may be of any type that has an order.  Null, empty and blank texts
    have no shingles, link nothing and are components of their own.  A document
    without an id links like any other; its component is the smallest id there is
    in it, or null.  Rows of one id with different texts are judged each by its
    text.  Repeated rows are each returned; an empty table gives no rows; extra
    columns are ignored.
    """
    spark = docs.sparkSession
    path = scratch_dir(spark)
    src = extra_columns(docs, [id_col, text_col]).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows, nodes, place = stored_sets(src, path)
    keys = written(rows.where("slice is null").select("id", "n", "node"), f"{path}/keys")
    sets = rows.where("tokens is not null").select("node", "n", "tokens")
    components = node_components(sets, frequency_classes(rows), f"{path}/graph")
    # the smallest id of a component; nodes without links are their own
    named = nodes.join(components, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = written(named.join(least, "component").select("node", "component_id"), f"{path}/named")
    for done in (place, f"{path}/graph"):  # the largest tables; what follows reads neither
        dropped(spark, done)
    out = keys.join(named, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def node_components(sets: DataFrame, classes: bytes, path: str) -> DataFrame:
    """(node, component) of every set that links with another."""
    per_token = Window.partitionBy("token")
    stats = sets.agg(F.count("*"), F.sum("n")).first()
    tokens = (stats[1] or 0) // 4 + stats[0]
    parts = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tokens // PARTITION_TOKENS))
    # a counter bounds the bucket of its tokens, so a task that collects whole buckets holds no more than this of one
    hot = int(8 * np.log2(max(HOT_BUCKET, 4 * (stats[1] or 0) / SLOTS)))
    met = written(met_tokens(prefix_tokens(sets, classes, parts, hot), parts), f"{path}/met")
    spread = met.where("size is null").select("token", "node").repartition("token").distinct()
    spread = spread.withColumn("size", F.count("*").over(per_token)).where("size > 1")
    per_node = Window.partitionBy("node")
    rows = met.where("size is not null").unionByName(spread).join(sets.groupBy("node").agg(F.max("n").cast("int").alias("n")), "node")
    # central sets lead: those whose tokens are shared most
    rows = rows.withColumns({"weight": F.sum(F.least("size", F.lit(10_000))).over(per_node), "kept": F.count("*").over(per_node), "open": _open(LEADERS[0]).over(per_node)})
    rows = rows.withColumn("rank", F.row_number().over(per_token.orderBy(F.desc("weight"), "node"))).drop("weight")
    rows = written(rows, f"{path}/ranked")
    alone = {"component": F.col("node"), "main": F.col("node"), "low": F.lit(0).cast("bigint"), "high": F.lit(0).cast("bigint")}
    pairs = written(cross_pairs(rows.withColumns(alone), LEADERS[0]), f"{path}/pairs0")
    found = written(linked(pairs, sets, f"{path}/0"), f"{path}/links0")
    components, tested, reach = connected_components(found), pairs, SMALL_BUCKET
    for k in itertools.count(1):
        # what is left: large buckets that are not of one component and not exhausted
        split = rows.where(F.col("size") > SMALL_BUCKET).drop("kept", "open").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        parted = split.groupBy("token", "component").agg(F.count("*").alias("members"), F.max("size").alias("most"))
        mixed = parted.groupBy("token").agg(F.max_by("component", "members").alias("main"), F.max("most").alias("most"), (F.sum("members") - F.max("members")).alias("others")).where("others > 0")
        mixed = written(mixed, f"{path}/mixed{k}")
        most, work = mixed.agg(F.max("most"), F.sum(F.col("others").cast("double") * F.col("most"))).first()
        if most is None or most <= reach:
            return components
        leaders = LEADERS[k] if k < len(LEADERS) else LEADERS[-1] * 16 ** (k - len(LEADERS) + 1)
        last = work <= AT_ONCE or leaders >= most
        # exhausted buckets stay in, as pairs are counted over all their common ones
        split = split.join(mixed.select("token", "main"), "token")
        split = split.join(split.groupBy("node").agg(F.count("*").alias("kept"), (F.lit(0) if last else _open(leaders)).alias("open"), _bits(False).alias("low"), _bits(True).alias("high")), "node")
        pairs = written(cross_pairs(split, None if last else leaders).join(tested, ["a", "b"], "left_anti"), f"{path}/pairs{k}")
        reach = max(SMALL_BUCKET, leaders)
        if not pairs.isEmpty():
            tested = tested.unionByName(pairs)
            found = written(found.unionByName(linked(pairs, sets, f"{path}/{k}")), f"{path}/links{k}")
            components = connected_components(found)
        if last:
            return components


def linked(pairs: DataFrame, sets: DataFrame, path: str) -> DataFrame:
    """The pairs that link, of a written table; the sets of their nodes are picked first."""
    known = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), f"{path}-known")
    return verified(pairs, written(picked(sets, known), f"{path}-sets"), path)
