"""Documents of rare or no language are judged too."""

import random

import pytest

pytest.importorskip("gridloom.llm")
from gridloom.llm import quality  # noqa: E402


def prose(rng):
    return "\n".join(" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(12)) for _ in range(6))


def junk(rng):
    return "\n".join(" ".join("#$%" * 25 + str(rng.random()) for _ in range(3)) for _ in range(20))


def judged(spark, rows):
    return {r.doc_id: r for r in quality.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}


@pytest.mark.parametrize("languages", [1, 12])  # few enough for the estimate of all documents; enough for one of their own
def test_rests_are_judged(spark, languages):
    rng = random.Random(languages)
    rows = [(i, prose(rng), "en", "web") for i in range(80)]
    rare = [(f"r{k}" if k else None, s) for k in range(languages) for s in ("a", "b", "c", None)]
    rows += [(1000 + i, prose(rng), lang, s) for i, (lang, s) in enumerate(rare)]
    rows += [(5000 + k, junk(rng), f"r{k}" if k else None, "a") for k in range(min(languages, 2))]
    got = judged(spark, rows)
    assert len(got) == len(rows)
    assert all(r.distance is not None and r.kept == (i < 5000) for i, r in got.items())
    assert not any(r.base_failed for r in got.values())


def test_few_in_all(spark):
    """No number of documents is too small to be judged."""
    rng = random.Random(3)
    got = judged(spark, [(i, prose(rng), "en", "web") for i in range(20)] + [(20, junk(rng), None, "web")])
    assert all(r.distance is not None and r.kept == (i < 20) for i, r in got.items())
    assert judged(spark, [(1, prose(rng), None, None)])[1].kept
