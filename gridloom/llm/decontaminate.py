"""Benchmark decontamination by a generalised suffix automaton.

The words of all benchmark items go into one suffix automaton.  Documents are
streamed through it word by word, tracking the length of the longest match that
ends at each word; where it reaches a window's length, the window's words are
hit.  Stretches in which every neighbouring pair of words is a pair of some item
are found first, by array operations, so the automaton only walks those.

The benchmark is read to the driver in blocks of at most BLOCK_CHARS
characters; each block is one automaton, broadcast, and one narrow pass over the
documents; between blocks the passes' results are written.  Memory is bounded by the block whatever the benchmark's size, and no
document is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import scratch_dir, written

from .common import arrow_map, extra_columns, kept, pieces, private, public

WINDOW = 10
BLOCK_CHARS = 4_000_000
#: Lower-cases A-Z and makes every ASCII character but letters and digits a space.
_WORDS = bytes((i + 32 if 65 <= i <= 90 else i) if i > 127 or chr(i).isalnum() else 32 for i in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, with the items that hold each window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[tuple[int, str]] = []
        short: list[tuple[int, str, int]] = []
        pairs: set[tuple[int, int]] = set()
        self.least = window
        for name, text in items:
            seq = [self.ids.setdefault(w, len(self.ids)) for w in words(text)]
            if not seq:
                continue
            pairs.update(zip(seq, seq[1:], strict=False))
            last = 0
            for c in seq:
                last = self._extend(last, c)
                ends.append((last, name))
            if len(seq) < window:
                short.append((last, name, len(seq)))
                self.least = min(self.least, len(seq))
        self._windows(ends, short)
        n = len(self.ids)
        self.pairs = np.array(sorted(a * n + b for a, b in pairs), np.int64)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        known = nxt[last].get(c)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is None:
            cur = self._node(length[last] + 1)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p == -1:
                link[cur] = 0
            else:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            return cur
        return self._clone(last, known, c)

    def _node(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(length)
        return len(self.len) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        """Splits off the strings of ``q`` that end in those of ``p`` and ``c``."""
        nxt, link = self.next, self.link
        clone = self._node(self.len[p] + 1)
        nxt[clone] = dict(nxt[q])
        link[clone] = link[q]
        link[q] = clone
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def _windows(self, ends: list[tuple[int, str]], short: list[tuple[int, str, int]]) -> None:
        """Per state: the items of its last ``window`` words, and the short items that end in it."""
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__)
        held: list[set[str]] = [set() for _ in self.len]
        for v, name in ends:
            held[v].add(name)
        for v in reversed(order):
            if self.len[self.link[v]] >= self.window:
                held[self.link[v]] |= held[v]
        self.items: list[frozenset[str] | None] = [None] * len(self.len)
        own: dict[int, set[str]] = {}
        for v, name, _ in short:
            own.setdefault(v, set()).add(name)
        self.own = {v: frozenset(s) for v, s in own.items()}
        self.above: list[tuple[int, ...]] = [()] * len(self.len)
        for v in order:
            up = self.link[v]
            if self.len[v] >= self.window:
                self.items[v] = self.items[up] if self.len[up] >= self.window else frozenset(held[v])
            self.above[v] = self.above[up] + ((up,) if up in self.own else ())

    def walk(self, seq: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit stretches (start, end) of word indices in ``seq`` and the items with occurring windows."""
        nxt, link, length, w = self.next, self.link, self.len, self.window
        v = run = 0
        hits: list[tuple[int, int]] = []
        found: set[str] = set()
        for i, c in enumerate(seq):
            while v and c not in nxt[v]:
                v = link[v]
                run = length[v]
            to = nxt[v].get(c)
            if to is None:
                v = run = 0
                continue
            v, run = to, run + 1
            if run >= w:
                found |= self.items[v]
                hits.append((i - w + 1, i + 1))
            if run == length[v] and v in self.own:
                found |= self.own[v]
                hits.append((i - run + 1, i + 1))
            for u in self.above[v]:
                found |= self.own[u]
                hits.append((i - length[u] + 1, i + 1))
        return hits, found

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Maximal stretches of at least the least window that use only known pairs."""
        if self.least == 1:
            ok = ids >= 0
            edge = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
            return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
        both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        if not len(both) or not len(self.pairs):
            return []
        code = ids[both] * len(self.ids) + ids[both + 1]
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        ok = np.zeros(len(ids) + 1, np.int8)
        ok[both[self.pairs[at] == code] + 1] = 1
        edge = np.flatnonzero(np.diff(ok))
        starts, stops = edge[::2], edge[1::2] + 1
        keep = stops - starts >= self.least
        return list(zip(starts[keep].tolist(), stops[keep].tolist(), strict=True))

    def search(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text its number of words, hit stretches and items."""
        get, flat, begins = self.ids.get, [], []
        for t in texts:
            begins.append(len(flat))
            flat += [get(x, -1) for x in words(t)]
            flat.append(-1)
        begins.append(len(flat))
        out = [(begins[k + 1] - begins[k] - 1, [], set()) for k in range(len(texts))]
        ids = np.array(flat, np.int64)
        for start, stop in self.stretches(ids):
            k = int(np.searchsorted(begins, start, "right")) - 1
            hits, found = self.walk(flat[start:stop])
            off = start - begins[k]
            out[k][1].extend((s + off, e + off) for s, e in hits)
            out[k][2].update(found)
        return out


def merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(hits):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for s, e in spans:
        out.append(text[last : at[s][0]])
        last = at[e - 1][1]
    return b"".join([*out, text[last:]])


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about ``block_chars`` characters, one block in memory at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")).where(F.col(f"`{text_col}`").isNotNull()).distinct()
    for name, text in rows.toLocalIterator():
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append(("" if name is None else name, text.encode()))
        size += len(text)
    yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, keep_text: bool = False, least_span: int = 0, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: id, n_words and n_hit (long), items array<string>
    (sorted ids of items with occurring windows), spans array<struct<start,end>>
    of hit words; with ``keep_text`` also every other column, and the text
    without the spans of at least ``least_span`` words.

    A null text has no words and stays null; null or empty items are no items;
    repeated documents are each judged; an empty benchmark hits nothing; extra
    columns are ignored without ``keep_text`` and kept with it, and a result whose
    name a kept column has gets an underscore.
    """
    spark = docs.sparkSession
    src, names = private(docs if keep_text else extra_columns(docs, [id_col, text_col]))
    text_col, made = names[text_col], ["n_words", "n_hit", "items", "spans"]
    base = list(src.columns)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>"
    schema = ", ".join([*(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in base), kinds])
    at = base.index(text_col)
    blocks = item_blocks(benchmark, item_col, item_text, block_chars)
    block, out, done = next(blocks), src, 0
    while block is not None:
        after = next(blocks, None)
        key = hashlib.sha256(repr((window, block)).encode()).digest()
        shared = spark.sparkContext.broadcast((key, block, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=not done, cut=keep_text and after is None) -> Iterator[pa.RecordBatch]:
            with kept(("automaton", shared.value[0]), lambda: SuffixAutomaton(*shared.value[1:])) as automaton:
                for whole in batches:
                    for batch in pieces(whole):
                        column = batch.column(at)
                        texts = [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
                        n, n_hit, items, spans = [], [], [], []
                        before = None if first else (batch.column(len(base) + 2).to_pylist(), batch.column(len(base) + 3).to_pylist())
                        clean = column.to_pylist() if cut else []
                        for k, (count, hits, found) in enumerate(automaton.search(texts)):
                            if before:
                                found |= set(before[0][k])
                                hits += [(s["start"], s["end"]) for s in before[1][k]]
                            hits = merged(hits) if hits else hits
                            n.append(count)
                            n_hit.append(sum(e - s for s, e in hits))
                            items.append(sorted(found))
                            spans.append([{"start": s, "end": e} for s, e in hits])
                            if cut and (long := [(s, e) for s, e in hits if e - s >= least_span]):
                                clean[k] = cut_words(texts[k], long).decode()
                        carried = [pa.array(clean, pa.string()) if cut and i == at else batch.column(i) for i in range(len(base))]
                        yield pa.RecordBatch.from_arrays(
                            [*carried, pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, span)],
                            names=[*base, *made],
                        )

        out = arrow_map(out, run, schema)
        if after is not None:  # one automaton at a time: chained passes would each keep a worker with its own
            out = written(out, f"{scratch_dir(spark)}/block{done}")
        block, done = after, done + 1
    return public(out, names if keep_text else {id_col: names[id_col]}, made)
