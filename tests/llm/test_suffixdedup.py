import hashlib
import random

import pytest

pytest.importorskip("gridloom.llm")
from gridloom.llm import suffixdedup  # noqa: E402
from gridloom.llm.queries import QUERIES  # noqa: E402


def plain(rows):
    count = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        for k in range(len(b) - 199):
            w = b[k : k + 200]
            count[w] = count.get(w, 0) + 1
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_column_bwt():
    rng = random.Random(1)
    for _ in range(60):
        strings = [bytes(rng.choice(b"ab" if rng.random() < 0.5 else b"abcdef") for _ in range(rng.randrange(1, 25))) for _ in range(rng.randrange(1, 9))]
        tail, common, place = suffixdedup.column_bwt(strings)
        want = sorted(s[k:] for s in strings for k in range(len(s) + 1))
        rank = place.copy()
        got = {}
        for s, text in enumerate(strings):
            for k in range(len(text) + 1):
                got[int(rank[s])] = text[k:]
                rank[s] = tail[rank[s]]
        assert [got[r] for r in range(len(want))] == want
        for r in range(1, len(want)):
            a, b = want[r - 1], want[r]
            n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert common[r] == n


def test_against_all_windows(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op4_suffix_dedup"](spark, sf).collect()), key=repr) == plain(docs)


@pytest.mark.parametrize("hot", [20_000, 3])
def test_made_cases(spark, hot):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(70), text(150)
    rows = [(i, t) for i, t in enumerate([None, "", "short", "a" * 199, "b" * 200, "c" * 201, "ab" * 400, "x" * 3000, text(20) * 30, base, base, base + " more"])]
    rows += [(100 + i, text(rng.randrange(1, 90)) + passage + text(rng.randrange(1, 90))) for i in range(15)]
    rows += [(200 + i, base[: rng.randrange(len(base))] + word() + base[rng.randrange(len(base)) :]) for i in range(15)]
    rows += [(None, text(60)), (9, base)]
    # rows without an id, and one id with different texts: only what repeats goes
    inner = text(40)
    rows += [(None, inner + inner + text(10)), (None, text(70)), (7, text(30) * 2), (7, text(80)), (7, text(80))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as spans")
    from pyspark.sql import functions as F

    out = suffixdedup.remove_repeats(df, hot_contexts=hot)
    got = out.select("doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)"), F.size("spans"), F.sha2("kept", 256))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)
    assert suffixdedup.remove_repeats(df.limit(0)).count() == 0
