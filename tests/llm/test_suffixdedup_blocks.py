"""Texts with more bytes than a hash has places: equal windows still meet under one key."""

import random

import numpy as np
import pytest

pytest.importorskip("gridloom.llm")
from gridloom.llm import suffixdedup as S  # noqa: E402


def texts(long):
    rng = random.Random(11)
    noise = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    passage = noise(700)
    far = noise(long) + passage + noise(long // 2) + passage[100:500] + b"x" * 900 + noise(300)
    return [far, b"", noise(150), *(noise(rng.randrange(50, 900)) + passage[k : k + 350] + noise(rng.randrange(50, 900)) for k in range(0, 350, 50)), passage, noise(200)]


@pytest.mark.parametrize("long", [500, 9000])
def test_more_bytes_than_places(monkeypatch, long):
    monkeypatch.setattr(S, "_POS", np.uint64((1 << 12) - 1))
    monkeypatch.setattr(S, "BLOCK", 1 << 10, raising=False)
    all_texts = texts(long)
    seen, keys = {}, {}
    for o, a, n, lead, k, c, *two in zip(*(x.tolist() for x in S.contexts(all_texts)), strict=True):
        keys.setdefault(k, {}).setdefault(c, []).append((o, a, n))
        marks = [two[i // 2] >> 32 * (1 - i % 2) & 0xFFFFFFFF for i in range(4)]
        for w in range(a, a + n):
            assert (o, w) not in seen
            (at,) = (i for i, (lo, hi) in enumerate(S.CLASSES) if lo <= lead - (w - a) < hi)
            seen[o, w] = (k, marks[at])
    where = {}
    for o, t in enumerate(all_texts):
        for w in range(len(t) - S.LENGTH + 1):
            where.setdefault(t[w : w + S.LENGTH], []).append((o, w))
    assert set(seen) == {p for places in where.values() for p in places}
    twice = {p for places in where.values() if len(places) > 1 for p in places}
    for places in where.values():
        assert len({seen[p][0] for p in places}) == 1
        assert len({seen[p][1] for p in places}) == 1  # pruning by classes keeps what is repeated
    found = set()
    for contexts in keys.values():
        lists = list(contexts.values())
        data = [all_texts[o][a : a + n - 1 + S.LENGTH] for o, a, n in (x[0] for x in lists)]
        many = np.array([len(x) > 1 for x in lists])
        for s, lo, hi in S.repeated_windows(data, many):
            found |= {(o, a + w) for o, a, _ in lists[s] for w in range(lo, hi)}
    assert found == twice and len(twice) > 1000
