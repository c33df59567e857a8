"""Secret scans: fixed patterns and a token-efficiency test.

A random string falls apart under a subword vocabulary: it needs a token for
every one or two characters, where words and names need one for three or more.
Runs of key characters with few characters per token, which are neither a known
kind of digest nor an identifier, are reported as ``random``.  A run with the
form of an identifier is judged by those of its parts that are not like words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import worker_tools
from .common import arrow_map, extra_columns, kept, pieces, private, public

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WORDS_OF_ASSIGN = ("passw", "secret", "token", "apikey", "api_key")
#: Digest lengths in hexadecimal digits, and shapes of identifiers, that are no secrets.
DIGESTS = frozenset({32, 40, 56, 64, 96, 128})
IDENTIFIER = re.compile(
    r"(?:[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}"  # UUID
    r"|[0-9_=+/-]+|[A-Za-z_=+/-]+"  # digits only, letters only
    r"|[a-z]+(?:[_/-][a-z0-9]+)*|[A-Z]+(?:[_/-][A-Z0-9]+)*"  # snake, kebab and path names
    r"|[A-Za-z][a-z]+(?:[A-Z][a-z]+)+[0-9]{0,4})",  # camel case
    re.IGNORECASE * 0,
)
UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}")
MARKS = re.compile(r"[_=+/-]+")
#: A part of a run that is like a word: letters in one case or camel case with at most a short number.
WORD = re.compile(r"(?:[a-z]+|[A-Z]+|[A-Z]?[a-z]+(?:[A-Z][a-z]+)*)[0-9]{0,4}")
#: Characters from which a word is judged by its tokens, and from which the parts that are not like words are.
LONG_WORD, LEAST_ODD = 12, 12
#: A run of fewer characters per token than this looks random.
LEAST_RATIO = 2.2
#: To bytes: key characters become "h", hexadecimal digits too in the second, all others a space.
_RUN_MAP = bytes(ord("h") if chr(i).isascii() and (chr(i).isalnum() or chr(i) in "+/_=-") else 32 for i in range(256))
_HEX_MAP = bytes(ord("h") if chr(i) in "0123456789abcdef" else 32 for i in range(256))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping per kind, in code points."""
    out: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(w in low for w in WORDS_OF_ASSIGN):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"h" * 32 in text.encode().translate(_HEX_MAP):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def is_digest(run: str) -> bool:
    return len(run) in DIGESTS and all(c in "0123456789abcdefABCDEF" for c in run)


def looks_random(run: str, count, least_ratio: float = LEAST_RATIO) -> bool:
    """The token-efficiency test of one run; ``count`` gives the tokens of a string.

    A run that has not the form of an identifier is judged whole.  All others, and
    those that words make pass as a whole, are judged by their parts between marks
    that are not like words, if these have LEAST_ODD characters together.
    """
    if is_digest(run):
        return False
    if not IDENTIFIER.fullmatch(run) and len(run) < least_ratio * count(run):
        return True
    if ACCESS.fullmatch(run):
        return False  # letters only, and reported as an access key already
    odd = size = 0
    for part in MARKS.split(UUID.sub("", run)):
        if not part or part.isdigit() or is_digest(part):
            continue
        if len(part) < LONG_WORD and WORD.fullmatch(part):
            continue
        tokens = count(part)
        if WORD.fullmatch(part) and len(part) >= least_ratio * tokens:
            continue
        odd, size = odd + tokens, size + len(part)
    return size >= LEAST_ODD and size < least_ratio * odd


def method_spans(text: str, count, least_ratio: float = LEAST_RATIO) -> list[tuple[int, int, str]]:
    """Spans that the token-efficiency test adds; ``count`` gives a run's tokens."""
    if b"h" * 20 not in text.encode().translate(_RUN_MAP):
        return []
    return [(m.start(), m.end(), "random") for m in RUN.finditer(text) if looks_random(m[0], count, least_ratio)]


def ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with each maximal run of covered characters replaced by ``mark``."""
    out, at = [], 0
    for start, end in merged((s, e) for s, e, _ in spans):
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def scan_secrets(docs: DataFrame, ranks_file: bytes, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", least_ratio: float = LEAST_RATIO, keep_text: bool = False) -> DataFrame:
    """One row per document: id, spans array<struct<start,end,kind>> by start then
    kind, and with ``keep_text`` the text with its secrets replaced (a null text
    stays null).

    Null text is empty: no spans.  Repeated rows are each scanned, null ids stay
    null, an empty table gives no rows.  With ``keep_text`` all other columns of
    ``docs`` come through unchanged, and the result is ``spans_`` if one of them is
    named spans; without it they are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((ranks_file, pattern))
    key = hashlib.sha256(ranks_file + pattern.encode()).digest()
    src, inner = private(docs if keep_text else extra_columns(docs, [id_col, text_col]))
    names, text = list(src.columns), text_col
    text_col = inner[text_col]
    at = names.index(text_col)
    carried = [c for c in src.columns if keep_text or c != text_col]
    schema = ", ".join([*(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in carried), "spans array<struct<start:int,end:int,kind:string>>"])
    struct = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with kept(("bpe", key), lambda: worker_tools(*shared.value)) as (piece, find):
            def count(run: str) -> int:
                return sum(piece.count(p) for p in find(run))

            for whole in batches:
                for batch in pieces(whole):
                    found, clean = [], []
                    for text in batch.column(at).to_pylist():
                        spans = ordered([*base_spans(text), *method_spans(text, count, least_ratio)]) if text else []
                        found.append([{"start": s, "end": e, "kind": k} for s, e, k in spans])
                        clean.append(redact(text, spans) if spans else text)
                    cols = [pa.array(clean, pa.string()) if i == at else batch.column(i) for i, c in enumerate(names) if c in carried]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(found, struct)], names=[*carried, "spans"])

    return public(arrow_map(src, run, schema), {c: n for c, n in inner.items() if keep_text or c != text}, ["spans"])
