import math
import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("gridloom.llm")
from gridloom.llm import katz  # noqa: E402


def plain(rows, order=2):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    docs = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]) for i, t in rows]
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in docs}
    train = [w for i, w in docs if not held[i]]
    uni = Counter(x for w in train for x in w)
    n, v = sum(uni.values()), len(uni)
    histories = lambda w, k: [tuple(["<s>"] * k + w)[i : i + k] for i in range(len(w))]

    def discount(counts):
        m = Counter(counts.values())
        return katz.discounts([m[r] for r in range(1, 7)])

    use = lambda d, c: (d[c] if c < len(d) else 1.0) * c
    d1 = discount(uni)
    kept = sum(use(d1, c) for c in uni.values())
    low_n = n if kept < n - 1e-9 else n + 1
    p1 = {w: use(d1, c) / low_n for w, c in uni.items()}
    unknown = 1 - sum(p1.values()) if n else 1.0
    levels = {}
    for k in range(1, order):
        grams = Counter((h, x) for w in train for h, x in zip(histories(w, k), w, strict=True))
        after = {}
        for (h, w), c in grams.items():
            after.setdefault(h, {})[w] = c
        levels[k] = (discount(grams), after)
    left = {}

    def p(h, w):
        if not h:
            return p1.get(w, unknown)
        d, after = levels[len(h)]
        if h not in after:
            return p(h[1:], w)
        c = sum(after[h].values())
        k = sum(use(d, x) for x in after[h].values())
        den = c if k < c - 1e-9 else c + 1
        if w in after[h]:
            return use(d, after[h][w]) / den
        if h not in left:
            left[h] = (1 - k / den) / (1 - sum(p(h[1:], x) for x in after[h]))
        return left[h] * p(h[1:], w)

    for _, after in levels.values():
        for h in [*after][:20]:
            assert sum(p(h, w) for w in [*uni, "\0unknown"]) == pytest.approx(1, abs=1e-9)
    out = []
    for i, w in docs:
        score = sum(math.log10(p(h, x)) for h, x in zip(histories(w, order - 1), w, strict=True))
        base = sum(math.log10((uni.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        out.append((i, held[i], len(w), sum(x in uni for x in w), n, base, score))
    return out


def check(df, want, **more):
    got = sorted(map(tuple, katz.score_documents(df, **more).collect()), key=repr)
    want = sorted(want, key=lambda r: repr(r))
    key = lambda r: (repr(r[:5]), round(r[5], 3))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)
    return got


def test_against_plain_model(spark, sf):
    rng = random.Random(4)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows = [(i, " ".join((t or "").split()[:300])) for i, t in rows]
    rows += [(5000 + i, " ".join(rng.choice(["the", "the", "A", "bé", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(60)))) for i in range(60)]
    rows += [(None, "no id"), (9001, None), (9002, ""), (9002, ""), (9003, "x" * 4000), (9004, "the " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "'x' as block")
    want = plain(rows)
    got = check(df, want)
    check(df, want, block_tokens=500, parts=7)
    third = plain(rows, 3)
    check(df, third, order=3)
    check(df, third, order=3, block_tokens=500, parts=7)
    assert sum(a[6] != b[6] for a, b in zip(want, third, strict=True)) > 50
    held = [r for r in got if r[1] and r[2] > 50]
    assert held and sum(r[6] for r in held) > sum(r[5] for r in held)


def test_edges(spark):
    held = [i for i in range(200) if katz.held_out(i)][:3]
    df = spark.createDataFrame([(i, "a b c") for i in held], "doc_id long, text string")
    for r in katz.score_documents(df).union(katz.score_documents(df, order=3)).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 4, 0, 0, 0.0, 0.0)
    assert katz.score_documents(df.limit(0)).count() == 0
