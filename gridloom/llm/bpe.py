"""Byte-level BPE by a lazily determinised finite-state transducer.

The encoding of every prefix of a byte string ends in exactly one token: the
suffix token that is compatible with the last token of what precedes it, where
two tokens are compatible if encoding their joined bytes gives the two again.
A state of the transducer therefore holds, for the bytes read since the last
token that is certain, the last token at each position from which a longer token
can still grow.  When the chains of all those positions share their first
tokens, these are certain and are emitted: the lookahead is bounded by the
longest token.  States and arcs are made when first needed and kept in a
bounded cache.

Decoding joins the tokens' bytes and passes them through an incremental UTF-8
state machine that holds back at most three bytes of an unfinished character.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, extra_columns, kept, pieces, texts

MAX_STATES = 150_000
MAX_PIECES = 200_000
#: Ids that the streaming decoder takes at once.
CHUNK = 4096
#: A pre-token pattern and one for ``re`` that splits texts of SAFE characters alike, several times as fast.
FAST = {
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+": r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+",
}
#: Characters that ``re`` and ``regex`` class alike as letter, digit, space or other.
UNSAFE = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: one base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x.strip())}


def merge_encode(ranks: dict[bytes, int], data: bytes) -> list[int]:
    """Plain BPE: joins the leftmost adjacent pair of lowest rank until none is left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Node(dict):
    """A node of the vocabulary's trie: children by byte, and the token that ends here, if merging its own bytes gives it."""

    __slots__ = ("token",)


class State(dict):
    """Arcs by byte, and what the bytes since the last certain token allow, whatever that token is.

    ``live`` has the positions from which a longer token can still grow, with
    their trie nodes, longest first; ``last`` the last token that ends at a
    position, ``chain`` a bit for each token end on the way to it.
    """

    __slots__ = ("chain", "final", "last", "live", "size")


class Transducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.tokens = {v: k for k, v in ranks.items()}
        self.length = {v: len(k) for k, v in ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.split: dict[int, tuple[bytes, bytes] | None] = {}
        self.edges: dict[tuple[int, int], list[tuple[bytes, int, int]]] = {}
        self.root = Node()
        self.root.token = None
        for t, i in ranks.items():
            node = self.root
            for b in t:
                child = node.get(b)
                if child is None:
                    child = node[b] = Node()
                    child.token = None
                node = child
            node.token = i
        self.whole: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self._state(0, ((0, self.root),), (0,), (0,), ())

    def _is_token(self, token: int) -> bool:
        """Whether merging a token's own bytes gives it."""
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = merge_encode(self.ranks, self.tokens[token]) == [token]
        return known

    def _fits(self, left: int, right: int) -> bool:
        key = left << 24 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 2 * self.max_states:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(left, right)
        return known

    def _halves(self, token: int) -> tuple[bytes, bytes] | None:
        """The two parts that the last merge of a token's own bytes joins; None for a byte."""
        if token not in self.split:
            parts = [self.tokens[token][i : i + 1] for i in range(len(self.tokens[token]))]
            while len(parts) > 2:
                ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
                i = min(ranked)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.split[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.split[token]

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """Parts that stand at one edge (0 left, 1 right) while a token is merged: bytes, rank when made, rank when joined to more."""
        key = (token, side)
        if key not in self.edges:
            out, end = [], 1 << 60
            while True:
                halves = self._halves(token)
                out.append((self.tokens[token], token if halves else -1, end))
                if not halves:
                    break
                end, token = token, self.ranks[halves[side]]
            self.edges[key] = out
        return self.edges[key]

    def _apart(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens never joins across their border.

        A part at the right edge of ``left`` and one at the left edge of
        ``right`` that exist at the same time would be joined if their join has a
        rank below that at which either is joined to more of its own token; at
        equal rank the merge further left goes first.
        """
        ranks, rights = self.ranks, self._edge(right, 0)
        for x, made_x, end_x in self._edge(left, 1):
            for y, made_y, end_y in rights:
                r = ranks.get(x + y)
                if r is not None:
                    when = max(r, made_x, made_y)
                    if when < end_x and when <= end_y:
                        return False
        return True

    def _state(self, size, live, last, chain, key) -> State:
        s = self.states.get(key)
        if s is None:
            s = self.states[key] = State()
            s.size, s.live, s.last, s.chain, s.final = size, live, last, chain, None
        return s

    def _ends(self, last: tuple[int, ...], at: int) -> list[int]:
        """The tokens on the way to position ``at``."""
        out = []
        while at:
            out.append(last[at])
            at -= self.length[last[at]]
        return out[::-1]

    def step(self, s: State, byte: int) -> list:
        """Makes the arc of ``byte``: [next state, tokens that are certain by then, first, other].

        If the bytes so far are a token, ``first``, it ends here provided that it
        fits the last certain token; ``other`` says what holds if it does not.
        """
        live, first, found = [], None, None
        for k, node in s.live:
            node = node.get(byte)
            if node is None:
                continue
            token = node.token
            if token is not None and (first is None if not k else found is None) and self._is_token(token):
                if not k:
                    first = token
                elif self._fits(s.last[k], token):
                    found = token
            if node:
                live.append((k, node))
        if first is None and found is None:
            raise ValueError("the vocabulary lacks a byte")
        if first is None:
            arc = [*self._target(s, live, found), None, None]
        else:
            arc = [*self._target(s, live, first), first, (live, found)]
        s[byte] = arc
        return arc

    def _target(self, s: State, live: list, token: int) -> tuple[State, list[int]]:
        """The state after ``token`` ends at the next position, and the tokens that are certain."""
        n, size = s.size + 1, self.length[token]
        bits = s.chain[n - size] | 1 << n
        last, chain = (*s.last, token), (*s.chain, bits)
        shared = kept = bits
        for k, _ in live:
            shared &= chain[k]
            kept |= chain[k]
        certain = shared.bit_length() - 1 if shared else 0
        # a token can only grow from a position on some way that is still open
        own = tuple([(k - certain, node) for k, node in (*live, (n, self.root)) if k >= certain])
        left = (0, *[last[k] if kept >> k & 1 else -1 for k in range(certain + 1, n + 1)])
        chain = tuple([x >> certain & ~1 if k == certain or kept >> k & 1 else 0 for k, x in enumerate(chain[certain:], certain)])
        target = self._state(n - certain, own, left, chain, (left, tuple([(k, id(node)) for k, node in own])))
        return target, self._ends(last, certain) if certain else ()

    def encode(self, data: bytes) -> list[int]:
        """Token ids of one pre-token, as the library gives them."""
        if data in self.ranks:
            return [self.ranks[data]]
        if len(self.states) > self.max_states:
            self._reset()
        s, out, previous, pairs = self.start, [], None, self.pairs
        for b in data:
            arc = s.get(b)
            if arc is None:
                arc = self.step(s, b)
            first = arc[2]
            if first is not None and previous is not None and not (self._fits(previous, first) if (known := pairs.get(previous << 24 | first)) is None else known):
                if arc[3].__class__ is tuple:
                    live, found = arc[3]
                    arc[3] = [*self._target(s, live, found), None, None]
                arc = arc[3]
            s = arc[0]
            if arc[1]:
                out += arc[1]
                previous = out[-1]
        if s.final is None:
            s.final = self._ends(s.last, s.size)
        return out + s.final

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


#: States of the UTF-8 machine besides 0 (between characters) and INVALID: range of the next byte and the state after it.
_DUE = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}
INVALID = 8


def utf8_table() -> np.ndarray:
    """table[state, byte] of the machine that accepts exactly well-formed UTF-8: no surrogates, no overlong forms, nothing above U+10FFFF."""
    table = np.full((9, 256), INVALID, np.uint8)
    table[0, :0x80] = 0
    table[0, 0xC2:0xE0] = 1
    table[0, 0xE0:0xF0] = 2
    table[0, 0xF0:0xF5] = 3
    table[0, [0xE0, 0xED, 0xF0, 0xF4]] = 4, 5, 6, 7
    for state, (lo, hi, after) in _DUE.items():
        table[state, lo : hi + 1] = after
    return table


class Utf8Machine:
    """Incremental UTF-8 decoding of tokens: the byte machine's table, lifted to whole tokens.

    ``feed`` takes the next ids and returns the bytes of all characters that are
    complete by then; of an unfinished character at most three bytes are held
    back.  Ill-formed bytes become U+FFFD as Python's decoder has it.
    """

    def __init__(self, tokens: dict[int, bytes]) -> None:
        most = max(tokens, default=-1) + 1
        self.bytes: list[bytes] = [tokens.get(i, b"") for i in range(most)]
        size = np.array([len(t) for t in self.bytes], np.int64)
        table, begin = utf8_table(), np.cumsum(size) - size
        flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        after = np.repeat(np.arange(9, dtype=np.uint8)[:, None], most, axis=1)
        for k in range(int(size.max(initial=0))):
            live = np.flatnonzero(size > k)
            after[:, live] = table[after[:, live], flat[begin[live] + k]]
        self.closed = after[0] == 0
        self.after = [row.tolist() for row in after]
        self.reset()

    def reset(self) -> None:
        self.state, self.tail = 0, b""

    def feed(self, ids: np.ndarray) -> bytes:
        tokens = ids.tolist()
        data = self.tail + b"".join([self.bytes[i] for i in tokens])
        state, after = self.state, self.after
        if state or not self.closed[ids].all():
            at, opened = 0, np.flatnonzero(~self.closed[ids]).tolist()
            for k in [*([0] if state else []), *opened]:  # between characters, closed tokens change nothing
                if k < at:
                    continue
                at = k
                while at < len(tokens):
                    state = after[state][tokens[at]]
                    at += 1
                    if not state or state == INVALID:
                        break
                if state == INVALID:
                    return self._repaired(data)
        self.state = state
        if not state:
            self.tail = b""
            return data
        cut = len(data) - 1
        while data[cut] & 0xC0 == 0x80:
            cut -= 1
        self.tail = data[cut:]
        return data[:cut]

    def _repaired(self, data: bytes) -> bytes:
        """Ill-formed bytes replaced; an unfinished character at the end is held back."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        text = reader.decode(data)
        self.tail, self.state = reader.getstate()[0], 0
        table = utf8_table()
        for b in self.tail:
            self.state = int(table[self.state, b])
        return text.encode()

    def close(self) -> bytes:
        """What is left at the end: an unfinished character is ill-formed."""
        tail = self.tail
        self.reset()
        return tail.decode("utf-8", "replace").encode()


def decode_stream(machine: Utf8Machine, chunks: Iterable[np.ndarray]) -> Iterator[bytes]:
    """UTF-8 text of a stream of id chunks, as early as whole characters allow."""
    machine.reset()
    for ids in chunks:
        if part := machine.feed(ids):
            yield part
    if part := machine.close():
        yield part


class PieceCache:
    """Ids, four bytes each, of the pre-tokens that this worker has met, in two generations.

    When the young one is full it becomes the old one; what is asked for again
    moves back.  So the size is bounded and frequent pre-tokens stay.
    """

    def __init__(self, machine: Transducer, most: int = MAX_PIECES):
        self.machine, self.most, self.known, self.old = machine, most, {}, {}
        self.utf8 = Utf8Machine(machine.tokens)
        self.decimals = [str(i) for i in range(max(machine.tokens, default=-1) + 1)]

    def __call__(self, piece: str) -> bytes:
        got = self.known.get(piece)
        if got is None:
            got = self.old.get(piece)
            if got is None:
                ids = self.machine.encode(piece.encode())
                got = struct.pack(f"{len(ids)}I", *ids)
            if len(piece) <= 64:
                if len(self.known) >= self.most:
                    self.old = self.known.copy()
                    self.known.clear()
                self.known[piece] = got
        return got

    def count(self, piece: str) -> int:
        return len(self(piece)) // 4


class Splitter:
    """All matches of the pre-token pattern, by the faster of two modules that agree on the text."""

    def __init__(self, pattern: str):
        import regex

        self.exact = regex.compile(pattern).findall
        self.fast = re.compile(FAST[pattern]).findall if pattern in FAST else None

    def __call__(self, text: str) -> list[str]:
        if self.fast and not UNSAFE.search(text):
            return self.fast(text)
        return self.exact(text)


def worker_tools(ranks_file: bytes, pattern: str) -> tuple[PieceCache, Splitter]:
    return PieceCache(Transducer(parse_ranks(ranks_file))), Splitter(pattern)


def encode_documents(docs: DataFrame, ranks_file: bytes, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """One row per document: its id and, of ``outputs``, n_tokens long, ids
    array<int>, decoded string, ids_sha256 and decoded_sha256 (hex digests of the
    ids joined by spaces and of the decoded bytes).

    Null text is empty: no ids.  Repeated rows give repeated results; a null id
    stays null; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((ranks_file, pattern))
    key = hashlib.sha256(ranks_file + pattern.encode()).digest()
    kinds = {"n_tokens": "bigint", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    src = extra_columns(docs, [id_col, text_col])
    schema = f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{o} {kinds[o]}" for o in outputs)
    arrow = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with kept(("bpe", key), lambda: worker_tools(*shared.value)) as tools:
            for whole in batches:
                for batch in pieces(whole):
                    cols = encoded(texts(batch.column(1)), tools, outputs)
                    yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(cols[o], arrow[o]) for o in outputs)], names=[id_col, *outputs])

    return arrow_map(src, run, schema)


def encoded(rows: list[str], tools: tuple[PieceCache, Splitter], outputs: tuple[str, ...]) -> dict[str, list]:
    """The outputs of texts, by name; what is decoded comes from the ids alone, by the streaming machine."""
    piece, find = tools
    get, decimals = piece.known.get, piece.decimals
    cols: dict[str, list] = {o: [] for o in outputs}
    for text in rows:
        ids = np.frombuffer(b"".join([get(p) or piece(p) for p in find(text)]), np.uint32)
        if "n_tokens" in cols:
            cols["n_tokens"].append(len(ids))
        if "ids" in cols:
            cols["ids"].append(ids.astype(np.int32))
        if "ids_sha256" in cols:
            cols["ids_sha256"].append(hashlib.sha256(" ".join([decimals[i] for i in ids.tolist()]).encode()).hexdigest())
        if "decoded" in cols or "decoded_sha256" in cols:
            digest, parts = hashlib.sha256(), []
            for part in decode_stream(piece.utf8, (ids[k : k + CHUNK] for k in range(0, len(ids), CHUNK))):
                digest.update(part)
                if "decoded" in cols:
                    parts.append(part)
            if "decoded_sha256" in cols:
                cols["decoded_sha256"].append(digest.hexdigest())
            if "decoded" in cols:
                cols["decoded"].append(b"".join(parts).decode())
    return cols
