"""The digest of the decoded text comes from the streaming decoder."""

import hashlib

import public_tokenizers as P
import pyarrow as pa
import pytest

pytest.importorskip("gridloom.llm")
from gridloom.llm import bpe  # noqa: E402
from gridloom.llm.common import read_file  # noqa: E402


def test_digest_is_streamed(spark, monkeypatch):
    taken, chunks, plain = [], [], bpe.decode_stream

    def spy(machine, parts):
        return plain(machine, (chunks.append(list(ids)) or ids for ids in parts))

    monkeypatch.setattr(bpe, "arrow_map", lambda df, fn, schema: taken.append(fn))
    monkeypatch.setattr(bpe, "decode_stream", spy)
    monkeypatch.setattr(bpe, "CHUNK", 3)
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    bpe.encode_documents(df, read_file(P.path("byte_bpe_50k.tiktoken")), P.PATTERN, outputs=("n_tokens", "decoded_sha256"))
    texts = ["", "plain words and more words", "aé漢😀ﬁ½ " * 40, None]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(texts)], names=["doc_id", "text"])
    out = pa.Table.from_batches(taken[0](iter([batch]))).to_pylist()
    assert [r["decoded_sha256"] for r in out] == [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
    assert sum(map(len, chunks)) == sum(r["n_tokens"] for r in out) > 100 and max(map(len, chunks)) == 3
