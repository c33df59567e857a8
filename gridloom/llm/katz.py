"""Language-model scores: a Katz backoff model of order 2 or 3 with Good-Turing discounts.

P(w | h) = d(c) c(h, w) / c(h) for n-grams seen in training, else a(h) P(w | h'),
where h' is h without its first word, P(w) = d(c) c(w) / N, the unseen mass goes
to one unknown word, and a(h) is what the discounts leave of h over what P leaves
outside the words seen after h; so every distribution sums to one over the
vocabulary and the unknown word.  A history never seen leaves all to h'.

The corpus is cut into blocks of whole documents.  A block sends each of its
distinct words, later each of its distinct pairs, once to the partition of the
word or history; the partition merges the counts into its part of the n-gram
table and answers every block in the order in which it asked.  So what is
shuffled are packed arrays of distinct n-grams a block, not tokens, and scoring
evaluates the recursion over a block's own documents.  Histories that hold a
large share of all tokens are spread over partitions by the following word.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import bucketed, dropped, scratch_dir, settled, ship, written

from .common import arrow_map, extra_columns, pack, pack_ints, unpack, unpack_ints

#: Tokens a block at least, tokens a partition of the tables, and the largest count that is discounted.
BLOCK_TOKENS, PARTITION_TOKENS, MOST_DISCOUNTED = 1_800_000, 2_500_000, 5
BEGIN, END = 1, 2  # hashes of the two marks; a word's hash is never below 16


def discounts(n: list[float], most: int = MOST_DISCOUNTED) -> list[float]:
    """Katz's d_0 .. d_most from counts of counts n[r - 1]; 1 where Good-Turing gives none in (0, 1]."""
    out = [1.0] * (most + 1)
    if not n[0] or not n[most]:
        return out
    common = (most + 1) * n[most] / n[0]
    for r in range(1, most + 1):
        if n[r - 1] and common < 1:
            d = ((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common)
            out[r] = d if 0 < d <= 1 else 1.0
    return out


def discounted(c: np.ndarray, d: list[float]) -> np.ndarray:
    """d(c) * c."""
    return np.asarray(d)[np.where(c < len(d), c, 0)] * c


class Unigrams:
    """P(w) by count: discounted, with the rest for the unknown word."""

    def __init__(self, total: int, n: list[float]):
        self.total, self.d = total, discounts(n)
        kept = sum((self.d[r] - 1) * r * n[r - 1] for r in range(1, MOST_DISCOUNTED + 1)) + total
        self.scale = 1.0 / total if total else 0.0
        if total and kept >= total:
            self.scale = 1.0 / (total + 1)
        self.unknown = 1 - kept * self.scale

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) * self.scale, self.unknown)


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def word_blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row a block: its documents' ids, held-out marks, token counts, local token ids, and the words' hashes and training counts."""
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"block string, ids array<{kind}>, held binary, sizes binary, tokens binary, words binary, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        local: dict[bytes, int] = {}
        ids, held, sizes, flat, n = [], [], [], [], 0

        def flush(id_type) -> pa.RecordBatch:
            tokens = np.concatenate(flat)
            mark = np.array(held, np.uint8)
            train = np.repeat(mark == 0, sizes)
            words = np.array([BEGIN, END, *(max(16, xxhash.xxh3_64_intdigest(w)) for w in local)], np.uint64)
            counts = np.bincount(tokens[train], minlength=len(words))
            counts[0] = int((mark == 0).sum())
            cols = [[f"{part}-{made}"], [ids], [pack(mark)], [pack_ints(np.array(sizes))], [pack_ints(tokens)], [pack(words)], [pack_ints(counts)]]
            types = [pa.string(), pa.list_(id_type), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["block", "ids", "held", "sizes", "tokens", "words", "counts"])

        id_type = None
        for batch in batches:
            id_type = batch.schema.types[0]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                words = (text.as_py() or b"").lower().split()
                add = local.setdefault
                flat.append(np.array([*[add(w, len(local) + 2) for w in words], 1], np.int64))
                ids.append(doc_id)
                held.append(held_out(doc_id))
                sizes.append(len(words) + 1)
                n += len(words) + 1
                if n >= block_tokens:
                    yield flush(id_type)
                    made += 1
                    local.clear()
                    ids, held, sizes, flat, n = [], [], [], [], 0
        if ids:
            yield flush(id_type)

    return arrow_map(docs, run, schema)


def count_words(blocks: DataFrame, parts: int) -> DataFrame:
    """The unigram table's parts (block null) and the answers to blocks: slots, global word ids and counts, by part."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                w, c = unpack(words, np.uint64), unpack_ints(counts)
                p = (w % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((w, p))
                edges = np.searchsorted(p[order], np.arange(parts + 1))
                rows = [(q, block, pack_ints(s), pack(w[s]), pack_ints(c[s])) for q in range(parts) if len(s := order[edges[q] : edges[q + 1]])]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), *[pa.binary()] * 3), strict=True)], names=["p", "block", "slots", "words", "counts"])

    asked = arrow_map(blocks.select("block", "words", "counts"), ask, "p int, block string, slots binary, words binary, counts binary")
    names = ["p", "block", "slots", "words", "gids", "counts", "stats"]

    def merge(t: pa.Table) -> pa.Table:
        p = t.column("p")[0].as_py()
        words = [unpack(x, np.uint64) for x in t.column("words").to_pylist()]
        counts = np.concatenate([unpack_ints(x) for x in t.column("counts").to_pylist()])
        known, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(at, counts, len(known)).astype(np.int64)
        real = total[(known != BEGIN) & (total > 0)]
        stats = [int(real.sum()), len(real), *(int((real == r).sum()) for r in range(1, MOST_DISCOUNTED + 2))]
        rows = [(p, None, None, pack(known), None, pack_ints(total), stats)]
        stop = 0
        for block, slots, w in zip(t.column("block").to_pylist(), t.column("slots").to_pylist(), words, strict=True):
            own, stop = at[stop : stop + len(w)], stop + len(w)
            rows.append((p, block, slots, None, pack_ints(own * parts + p), pack_ints(total[own]), None))
        kinds = (pa.int32(), pa.string(), *[pa.binary()] * 4, pa.list_(pa.int64()))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return asked.groupBy("p").applyInArrow(merge, "p int, block string, slots binary, words binary, gids binary, counts binary, stats array<bigint>")


class Grams:
    """The distinct (history, word) of one level of a block, in the order of part, history and word.

    ``keys`` and ``counts`` are the histories' numbers, the same in all blocks, and
    training counts; histories with more than ``hot`` are spread over parts by word.
    """

    def __init__(self, history: np.ndarray, word: np.ndarray, keys: np.ndarray, counts: np.ndarray, gid: np.ndarray, parts: int, hot: float):
        n = len(gid)
        code, at = np.unique(history * n + word, return_inverse=True)
        self.at = at.astype(np.int32)
        del at
        self.h, self.w = (code // n).astype(np.int32), (code % n).astype(np.int32)
        del code
        self.key, self.word = keys[self.h], gid[self.w]
        home = self.key % parts
        part = np.where(counts[self.h] > hot, (home + self.word * 7919) % parts, home).astype(np.int32)
        del home
        self.order = np.lexsort((self.word, self.key, part))
        self.edges = np.searchsorted(part[self.order], np.arange(parts + 1))

    def somewhere(self) -> np.ndarray:
        """For each gram a token at which it ends."""
        out = np.empty(len(self.h), np.int64)
        out[self.at] = np.arange(len(self.at))
        return out

    def questions(self, block: str, trained: np.ndarray, low: np.ndarray, den: np.ndarray | None) -> list[tuple]:
        """A row a part: histories, words and training counts, and what the lower level knows of the words after them."""
        out = []
        for q in range(len(self.edges) - 1):
            s = self.order[self.edges[q] : self.edges[q + 1]]
            if len(s):
                out.append((q, block, pack_ints(np.diff(self.key[s], prepend=0)), pack_ints(self.word[s]), pack_ints(trained[s]), pack_ints(low[s]), None if den is None else pack_ints(den[s])))
        return out

    def read(self, answers: list[dict]) -> np.ndarray:
        """The counts of all grams from the parts' answers."""
        seen = np.zeros(len(self.h), np.int64)
        for a in answers:
            seen[self.order[self.edges[a["p"]] : self.edges[a["p"] + 1]]] = unpack_ints(a["c"])
        return seen


class Block:
    """A block with what the word table told it."""

    def __init__(self, row: dict, parts: int, hot: float):
        n = len(unpack(row["words"], np.uint64))
        self.name, self.parts, self.hot = row.get("block"), parts, hot
        self.gid, self.count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.denominator, self.weight = np.zeros(n), np.ones(n)
        for a in row["answers"]:
            s = unpack_ints(a["slots"])
            self.gid[s], self.count[s] = unpack_ints(a["gids"]), unpack_ints(a["counts"])
            if "weight" in a:
                self.denominator[s], self.weight[s] = unpack_ints(a["denominator"]), unpack(a["weight"], np.float64)
        self.sizes, self.word = unpack_ints(row["sizes"]), unpack_ints(row["tokens"])
        self.held = unpack(row["held"], np.uint8)
        self.start = np.cumsum(self.sizes) - self.sizes
        self.pairs = self._grams(self.word, 0, self.gid, self.count)

    def _grams(self, before: np.ndarray, first: int, keys: np.ndarray, counts: np.ndarray) -> Grams:
        history = np.empty(len(self.word), np.int64)
        history[1:] = before[:-1]
        history[self.start] = first
        return Grams(history, self.word, keys, counts, self.gid, self.parts, self.hot)

    def triples(self, seen: np.ndarray) -> Grams:
        """The next level: histories are the pairs, with their training counts, and at a document's start two begin marks."""
        p = self.pairs
        self.of_history = np.append(seen, self.count[0])
        keys = np.append(p.key << 32 | p.word, self.gid[0] << 32 | self.gid[0])
        return self._grams(p.at, len(p.h), keys, self.of_history)

    def trained(self, g: Grams) -> np.ndarray:
        return np.bincount(g.at, np.repeat(self.held == 0, self.sizes), len(g.h)).astype(np.int64)


_ASKED = ["p", "block", "h", "w", "c", "low", "den"]


def count_grams(joined: DataFrame, parts: int, hot: float, level: int) -> DataFrame:
    """One level's table by part (block null) and the answers to blocks: counts in the order of the block's question.

    The table has histories, words, counts, and of the words their counts at the
    lower level, for triples also the denominators there.
    """
    kinds = (pa.int32(), pa.string(), *[pa.binary()] * 5)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                b = Block(row, parts, hot)
                if level == 2:
                    rows = b.pairs.questions(b.name, b.trained(b.pairs), b.count[b.pairs.w], None)
                else:
                    seen = b.pairs.read(row["pairs"])
                    g = b.triples(seen)
                    of = b.pairs.at[g.somewhere()]
                    rows = g.questions(b.name, b.trained(g), seen[of], b.denominator[b.pairs.h[of]].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_ASKED)

    asked = arrow_map(joined, ask, "p int, block string, h binary, w binary, c binary, low binary, den binary")

    def merge(t: pa.Table) -> pa.Table:
        p = t.column("p")[0].as_py()
        hs = [np.cumsum(unpack_ints(x)) for x in t.column("h").to_pylist()]
        h, w, c, low = np.concatenate(hs), *(np.concatenate([unpack_ints(x) for x in t.column(k).to_pylist()]) for k in ("w", "c", "low"))
        order = np.lexsort((w, h))
        first = np.ones(len(h), bool)
        first[1:] = (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])
        start = np.flatnonzero(first)
        total = np.add.reduceat(c[order], start)
        at = np.empty(len(h), np.int64)
        at[order] = np.cumsum(first) - 1
        seen = total > 0
        kept = order[start][seen]
        n = total[seen]
        stats = [int((n == r).sum()) for r in range(1, MOST_DISCOUNTED + 2)]
        den = pack_ints(np.concatenate([unpack_ints(x) for x in t.column("den").to_pylist()])[kept]) if level > 2 else None
        rows = [(p, None, pack_ints(np.diff(h[kept], prepend=0)), pack_ints(w[kept]), pack_ints(n), pack_ints(low[kept]), den, stats)]
        stop = 0
        for block, own in zip(t.column("block").to_pylist(), hs, strict=True):
            rows.append((p, block, None, None, pack_ints(total[at[stop : stop + len(own)]]), None, None, None))
            stop += len(own)
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (*kinds, pa.list_(pa.int64())), strict=True)], names=[*_ASKED, "stats"])

    return asked.groupBy("p").applyInArrow(merge, "p int, block string, h binary, w binary, c binary, low binary, den binary, stats array<bigint>")


def triple_weights(table: DataFrame, joined: DataFrame, parts: int, hot: float, d2: list[float], d3: list[float]) -> DataFrame:
    """(block, p, h, n, kept, mass): what each part knows of the pairs as histories that a block needs, for backing off or since no discount is certain."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                b = Block(row, parts, hot)
                g = b.triples(b.pairs.read(row["pairs"]))
                seen, of = g.read(row["triples"]), b.of_history[g.h]
                need = (of > 0) & ((seen == 0) | (discounted(seen, d3) >= seen))
                keys, i = np.unique(g.key[need], return_index=True)
                wide = of[need][i] > hot
                rows = [(q, b.name, pack_ints(x)) for q in range(parts) if len(x := keys[(keys % parts == q) | wide])]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.int32(), pa.string(), pa.binary()), strict=True)], names=["p", "block", "h"])

    asked = arrow_map(joined, ask, "p int, block string, h binary")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, known = [], np.empty(0, np.int64)
        sums = [np.empty(0)] * 3
        if left.num_rows:
            row = left.slice(0, 1).to_pylist()[0]
            h, c, low, den = np.cumsum(unpack_ints(row["h"])), *(unpack_ints(row[k]) for k in ("c", "low", "den"))
            known, at = np.unique(h, return_inverse=True)
            sums = [np.bincount(at, x, len(known)) for x in (c, discounted(c, d3), discounted(low, d2) / np.maximum(den, 1))]
        for block, raw in zip(right.column("block").to_pylist(), right.column("h").to_pylist(), strict=True):
            keys = unpack_ints(raw)
            i = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            hit = known[i] == keys if len(known) else np.zeros(len(keys), bool)
            own = i[hit]
            rows.append((right.column("p")[0].as_py(), block, pack_ints(keys[hit]), *(pack(x[own]) for x in sums)))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, (pa.int32(), pa.string(), *[pa.binary()] * 4), strict=True)], names=["p", "block", "h", "n", "kept", "mass"])

    return table.groupBy("p").cogroup(asked.groupBy("p")).applyInArrow(answer, "p int, block string, h binary, n binary, kept binary, mass binary")


def backoff_weights(table: DataFrame, answers: DataFrame, parts: int, unigrams: Unigrams, d: list[float]) -> DataFrame:
    """Answers to blocks with each word's denominator and backoff weight as a history (0 and 1 if it was none)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, c, cw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                h, c, p = np.cumsum(unpack_ints(h)), unpack_ints(c), unigrams(unpack_ints(cw))
                known, at = np.unique(h, return_inverse=True)
                s = [np.bincount(at, x, len(known)) for x in (c, discounted(c, d), p)]
                q = known % parts
                rows += [(int(k), pack(known[q == k]), *(pack(x[q == k]) for x in s)) for k in np.unique(q)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["p", "h", "n", "kept", "mass"])

    part = arrow_map(table.select("h", "c", "low"), sums, "p int, h binary, n binary, kept binary, mass binary")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        read = lambda k, t: np.concatenate([np.empty(0, t), *(unpack(x, t) for x in left.column(k).to_pylist())])
        known, at = np.unique(read("h", np.int64), return_inverse=True)
        n, kept, mass = (np.bincount(at, read(k, np.float64), len(known)) for k in ("n", "kept", "mass"))
        denominator = np.where(kept < n - 1e-9, n, n + 1)
        weight = (1 - kept / denominator) / (1 - mass)
        rows = []
        for block, slots, gids, counts in zip(*(right.column(k).to_pylist() for k in ("block", "slots", "gids", "counts")), strict=True):
            g = unpack_ints(gids)
            i = np.minimum(np.searchsorted(known, g), max(len(known) - 1, 0))
            hit = known[i] == g if len(known) else np.zeros(len(g), bool)
            a, b = np.zeros(len(g), np.int64), np.ones(len(g))
            a[hit], b[hit] = denominator[i[hit]], weight[i[hit]]
            rows.append((block, slots, gids, counts, pack_ints(a), pack(b)))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, (pa.string(), *[pa.binary()] * 5), strict=True)], names=["block", "slots", "gids", "counts", "denominator", "weight"])

    schema = "block string, slots binary, gids binary, counts binary, denominator binary, weight binary"
    return part.groupBy("p").cogroup(answers.select("p", "block", "slots", "gids", "counts").groupBy("p")).applyInArrow(answer, schema)


def backed_off(seen: np.ndarray, d: list[float], denominator: np.ndarray, weight: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """One step of the recursion: the discounted share of what was seen, else the weighted lower probability."""
    return np.where(seen > 0, discounted(seen, d) / np.maximum(denominator, 1), weight * lower)


def third_level(b: Block, g: Grams, above: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Denominators and backoff weights of all pairs as histories; those that were never asked for are not needed beyond their counts."""
    denominator, weight = b.of_history.astype(float), np.ones(len(b.of_history))
    if above:
        keys = np.concatenate([unpack_ints(a["h"]) for a in above])
        n, kept, mass = (np.concatenate([unpack(a[k], np.float64) for a in above]) for k in ("n", "kept", "mass"))
        known, at = np.unique(keys, return_inverse=True)
        n, kept, mass = (np.bincount(at, x, len(known)) for x in (n, kept, mass))
        den = np.where(kept < n - 1e-9, n, n + 1)
        if len(known):
            i = np.minimum(np.searchsorted(known, g.key), len(known) - 1)
            hit = known[i] == g.key
            denominator[g.h[hit]], weight[g.h[hit]] = den[i[hit]], ((1 - kept / den) / (1 - mass))[i[hit]]
    return denominator, weight


def _by_block(answers: DataFrame, columns: list[str], name: str) -> DataFrame:
    return answers.groupBy("block").agg(F.collect_list(F.struct(*columns)).alias(name))


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = 2, block_tokens: int = BLOCK_TOKENS, parts: int | None = None, path: str | None = None) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens (long), base_score, score (log10, double).

    Documents whose crc32 of the id as text is divisible by 10 are held out of
    the counts.  Null text is empty: one end token.  Repeated rows count and are
    scored each; a null id counts as an empty one; an empty table gives no rows;
    without training documents every word is the unknown one.  ``order`` is 2 or 3.
    The n-gram tables stay under ``path``: ``words``, ``pairs`` and ``triples``, by part.
    """
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    spark = docs.sparkSession
    ship(spark)
    path = path or scratch_dir(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    src = extra_columns(docs, [id_col, text_col]).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # by block, so that answers come to the blocks and no token is shuffled
    blocks = bucketed(word_blocks(src, block_tokens), f"{path}/blocks", "block")
    n_blocks = blocks.count()
    if parts is None:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_blocks * block_tokens / PARTITION_TOKENS))
    words = written(count_words(blocks, parts), f"{path}/words")
    settled(spark)
    add = lambda df, n: df.where("block is null").agg(*[F.sum(F.col("stats")[i]) for i in range(n)]).first()
    s = [x or 0 for x in add(words, MOST_DISCOUNTED + 3)]
    total, types, unigrams = s[0], s[1], Unigrams(s[0], s[2:])
    hot = total / (2 * parts)
    word_answers = words.where("block is not null")
    asking = blocks.join(_by_block(word_answers, ["slots", "gids", "counts"], "answers"), "block")
    own = ["block", "held", "sizes", "tokens", "words", "answers"]
    pairs = written(count_grams(asking.select(own), parts, hot, 2), f"{path}/pairs")
    settled(spark)
    d = discounts([x or 0 for x in add(pairs, MOST_DISCOUNTED + 1)])
    weights = backoff_weights(pairs.where("block is null"), word_answers, parts, unigrams, d)
    weights = written(weights, f"{path}/weights")
    settled(spark)
    told = _by_block(weights, ["slots", "gids", "counts", "denominator", "weight"], "answers")
    counted = _by_block(pairs.where("block is not null"), ["p", "c"], "pairs")
    joined, d3 = blocks.join(told, "block").join(counted, "block"), None
    if order == 3:
        triples = written(count_grams(joined.select(*own, "pairs"), parts, hot, 3), f"{path}/triples")
        settled(spark)
        d3 = discounts([x or 0 for x in add(triples, MOST_DISCOUNTED + 1)])
        joined = joined.join(_by_block(triples.where("block is not null"), ["p", "c"], "triples"), "block")
        above = written(triple_weights(triples.where("block is null"), joined.select(*own, "pairs", "triples"), parts, hot, d, d3), f"{path}/above")
        joined = joined.join(_by_block(above, ["h", "n", "kept", "mass"], "above"), "block", "left")
    joined = joined.select("ids", *own, "pairs", *(["triples", "above"] if order == 3 else []))
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                b = Block(row, parts, hot)
                seen = b.pairs.read(row["pairs"])
                lower = unigrams(b.count)
                prob = backed_off(seen, d, b.denominator[b.pairs.h], b.weight[b.pairs.h], lower[b.pairs.w])
                at = b.pairs.at
                if order == 3:
                    g = b.triples(seen)
                    n, weight = third_level(b, g, row["above"])
                    prob, at = backed_off(g.read(row["triples"]), d3, n[g.h], weight[g.h], prob[at[g.somewhere()]]), g.at
                log, start = np.log10(prob)[at], b.start
                base = np.log10((b.count + 0.1) / (total + 0.1 * (types + 1)))[b.word]
                cols = [batch.column(0).slice(k, 1).flatten(), pa.array(b.held.astype(bool)), pa.array(b.sizes), pa.array(np.add.reduceat((b.count[b.word] > 0).astype(np.int64), start)), pa.array(np.full(len(start), total, np.int64)), pa.array(np.add.reduceat(base, start)), pa.array(np.add.reduceat(log, start))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    scores = written(arrow_map(joined, run, schema), f"{path}/scores")
    for done in ("blocks", "weights"):
        dropped(spark, f"{path}/{done}")
    return scores
