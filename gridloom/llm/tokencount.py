"""Token counts by a map-side two-tier lookup, without a pre-token shuffle.

Tier one is a broadcast hash table from frequent pre-tokens to their lengths in
tokens, counted map-side over all documents; tier two encodes what it lacks and keeps the lengths in a bounded cache of the worker.  The table only saves
work: counts do not depend on which pre-tokens it holds.  No document and no
pre-token of the count itself is shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, extra_columns, kept, pieces, texts

#: Pre-tokens that a task keeps counts of when it drops the rarest, and entries of the frequent table, of which a task sends as many at most.
MOST_COUNTED, FREQUENT = 200_000, 60_000
MAX_CACHE = 200_000
#: Characters on which Python and the library agree in lower case, letters, digits and spaces.
UNSAFE = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-įĲ-ɏ‐-‧‰-⁞€]")
#: The pre-tokenizer of word_bpe files as the library's file states it, and one for ``re`` on safe texts.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class Counter2:
    """Lengths of texts in tokens under one tokenizer file."""

    def __init__(self, raw: bytes, frequent: dict[str, int] | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(raw.decode())
        spec = json.loads(raw)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.split = self._known_shape(spec)
        self.frequent, self.cache, self.old = frequent or {}, {}, {}

    @staticmethod
    def _known_shape(spec: dict) -> bool:
        """Whether the file normalises and splits as this module's fast path does; otherwise the library does it all."""
        steps = [(n["type"], n.get("pattern"), n.get("content")) for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pres = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (
            steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            and len(pres) == 2 and pres[0]["type"] == "Split" and pres[0]["pattern"] == {"Regex": SPLIT} and pres[0]["invert"] and pres[0]["behavior"] == "Removed"
            and pres[1]["type"] == "ByteLevel" and not pres[1]["add_prefix_space"] and not pres[1]["use_regex"]
            and spec.get("truncation") is None and spec.get("padding") is None
        )

    def pieces(self, text: str) -> list[str] | None:
        """Pre-tokens of a text; None where only the library's own reading is certain to be right."""
        if not self.split or UNSAFE.search(text) or any(s in text for s in self.specials):
            return None
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return FAST.findall(text.lower())

    def length(self, piece: str) -> int:
        """Tier two: the worker's cache, else the library."""
        n = self.cache.get(piece)
        if n is None:
            n = self.old.get(piece)
            if n is None:
                n = len(self.library.encode(piece, add_special_tokens=False).ids)
            if len(piece) <= 64:
                if len(self.cache) >= MAX_CACHE:
                    self.old, self.cache = self.cache, {}
                self.cache[piece] = n
        return n

    def count(self, text: str) -> int:
        parts = self.pieces(text)
        if parts is None:
            return len(self.library.encode(text, add_special_tokens=False).ids)
        get, length = self.frequent.get, self.length
        return sum([get(p) or length(p) for p in parts])


def pack(lengths: dict[str, int]) -> bytes:
    """The frequent table as compact bytes: pre-tokens a line, by length."""
    by: dict[int, list[str]] = {}
    for p, n in lengths.items():
        by.setdefault(n, []).append(p)
    return json.dumps({str(n): "\n".join(ps) for n, ps in by.items()}, ensure_ascii=False).encode()


def unpack(table: bytes) -> dict[str, int]:
    return {p: int(n) for n, ps in json.loads(table).items() for p in ps.split("\n")}


def frequent_lengths(docs: DataFrame, raw: bytes, *, text_col: str = "text", entries: int = FREQUENT) -> dict[str, int]:
    """The most frequent pre-tokens of all documents with their lengths.

    Each task counts all that it reads and sends its most frequent pre-tokens; their
    sums are ranked, and ``entries`` of them come to the driver.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    some = docs.select(text.alias("t")).where(text.isNotNull())
    shared = spark.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, seen = Counter2(shared.value), Counter()
        for whole in batches:
            for batch in pieces(whole):
                for t in texts(batch.column(0)):
                    seen.update(p for p in c.pieces(t) or () if len(p) <= 64)
                    if len(seen) > 2 * MOST_COUNTED:
                        seen = Counter(dict(seen.most_common(MOST_COUNTED)))
        got = seen.most_common(entries)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.string()), pa.array([n for _, n in got], pa.int64())], names=["piece", "n"])

    sums = arrow_map(some, run, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    c = Counter2(raw)
    return {r.piece: c.length(r.piece) for r in sums.orderBy(F.desc("n"), "piece").limit(entries).collect()}


def token_counts(docs: DataFrame, tokenizer_file: bytes, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per document: id, n_bytes and n_tokens (long), over_limit (n_tokens > ``limit``).

    Null text is empty: 0 bytes, 0 tokens.  Repeated rows are each counted, null
    ids stay null, an empty table gives no rows, other columns are ignored.
    """
    spark = docs.sparkSession
    table = pack(frequent_lengths(docs, tokenizer_file, text_col=text_col))
    shared = spark.sparkContext.broadcast((tokenizer_file, table))
    key = hashlib.sha256(tokenizer_file + table).digest()
    src = extra_columns(docs, [id_col, text_col])
    schema = f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with kept(("tokens", key), lambda: Counter2(shared.value[0], unpack(shared.value[1]))) as counter:
            for whole in batches:
                for batch in pieces(whole):
                    got = texts(batch.column(1))
                    tokens = [counter.count(t) for t in got]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), pa.array([len(t.encode()) for t in got], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                        names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                    )

    return arrow_map(src, run, schema)
