"""The transducer asks about a pair of tokens once, then reads what it knows."""

from gridloom.llm.bpe import Transducer, merge_encode


def test_known_pairs_are_not_asked_again(monkeypatch):
    ranks = {bytes([i]): i for i in range(256)} | {b: 256 + i for i, b in enumerate([b"ab", b"bc", b"abc", b"ca", b"cab", b"aa"])}
    m, data = Transducer(ranks), b"abcabcaabcabbcaacab" * 4
    assert m.encode(data) == merge_encode(ranks, data)
    asked, of = [], m._fits
    monkeypatch.setattr(m, "_fits", lambda left, right: (asked.append(1), of(left, right))[1])
    assert m.encode(data) == merge_encode(ranks, data) and not asked
