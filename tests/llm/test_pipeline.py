import hashlib
import re

import public_tokenizers as P
import pytest

pytest.importorskip("gridloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from gridloom.llm import bpe, secrets  # noqa: E402
from gridloom.llm.common import read_file  # noqa: E402


def test_pipeline_against_plain_python(spark, sf, tmp_path):
    import tiktoken
    from test_jaccard import plain
    from test_text_operators import plain_words

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, seen = docs.columns, []
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r.doc_id: r for r in kept.collect()})
        if k < 4:
            assert kept.columns == names, name
    everything = {r.doc_id: r for r in docs.collect()}
    assert 0 < len(seen[0]) < len(everything) and all(seen[0][i] == everything[i] for i in seen[0])
    groups = {c for _, _, c in plain([(i, r.text) for i, r in seen[0].items()])}
    assert set(seen[1]) == groups
    bench = [plain_words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in bench for i in range(max(1, len(w) - 9))}
    for i, r in seen[1].items():
        w = plain_words(r.text)
        hit = {j for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for j in range(k, k + n)}
        if len(hit) > 0.5 * len(w):
            assert i not in seen[2]
        else:
            assert plain_words(seen[2][i].text) == [x for k, x in enumerate(w) if k not in hit]
            assert hit or seen[2][i].text == r.text
    raw = read_file(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(raw), special_tokens={})
    assert set(seen[3]) == set(seen[2]) == set(seen[4])
    for i, r in seen[3].items():
        assert not secrets.base_spans(r.text) and len(r.text) == r.n_chars
        assert not re.search("AKIA[A-Z0-9]{12}", r.text)
        ids = enc.encode_ordinary(r.text)
        got = seen[4][i]
        assert got.ids == ids and got.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    again = corpus_pipeline.run(spark, sf)
    assert {r.doc_id: r for r in again.collect()} == seen[4]


def test_stages_on_odd_rows(spark, sf, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and ids, clashing names, and an empty table."""
    from pyspark.sql import functions as F

    text = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"item{i}" for i in range(60))
    rows = [
        (1, text, "en", "a", 5), (1, other, "en", "a", 5), (1, other + " end", None, None, None), (2, None, "en", "a", None), (2, "", None, "a", 0), (2, "", None, "a", 0),
        (None, text, "en", "a", 1), (None, " ".join(f"x{i}" for i in range(40)), None, None, 2), (4, text, "en", "a", 5), (4, text, "en", "a", 5), (5, " ".join(f"long{i}" for i in range(60_000)), "en", None, 1),
        (6, "password = hunter2hunter2 " + " ".join(f"s{i}" for i in range(40)), "en", "a", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("distance", "spans", "kept", "items", "n_words", "component_id", "node", "tokens", "_key", "id"):
        docs = docs.withColumn(c, F.lit("x"))
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    key = lambda df: sorted(((r.doc_id, (r.text or "")[:40]) for r in df.collect()), key=repr)
    outs = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):  # a result is written before the next stage begins
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/odd{k}")
        outs[name] = spark.read.parquet(f"{tmp_path}/odd{k}")
    for name, out in outs.items():
        if name != "byte-level BPE encoding":
            assert out.columns == docs.columns, name
            assert all(r.distance == r.spans == r.kept == r.id == "x" for r in out.collect()), name
    assert len(outs["quality rules"].collect()) == 9  # the three without words fail
    # one row of each group: text (least id 1), the pair of other texts under id 1, and all that link with nothing
    assert key(outs["n-gram Jaccard join"]) == sorted([(1, text[:40]), (1, other[:40]), (2, ""), (2, ""), (2, ""), (None, rows[7][1][:40]), (5, rows[10][1][:40]), (6, rows[11][1][:40])], key=repr)
    assert key(outs["benchmark decontamination"]) == sorted(((r[0], (r[1] or "")[:40]) for r in rows), key=repr)
    secret = outs["secret scans"].collect()
    assert len(secret) == len(rows) and sum(r.text is None for r in secret) == 1 and all("hunter2" not in (r.text or "") for r in secret)
    encoded = outs["byte-level BPE encoding"].collect()
    assert len(encoded) == len(rows) and sum(r.n_tokens == 0 for r in encoded) == 3
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
