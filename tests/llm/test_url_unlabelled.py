"""Hosts without labelled pages are judged by their domain, then by their suffix."""

import pytest

pytest.importorskip("gridloom.llm")
from gridloom.llm import hosts  # noqa: E402


def test_hosts_without_labels(spark):
    labelled = [(f"{h}{i}.{d}", bad) for d, bad in (("bad.com", 1), ("good.com", 0), ("one.zz", 1), ("two.zz", 1), ("fine.yy", 0)) for h in "ab" for i in range(10)]
    own = ["new.bad.com", "bad.com", "new.good.com", "new.other.zz", "other.zz", "new.other.yy", "new.other.qq"]
    pages = spark.createDataFrame([(i, f"x://{h}/p") for i, h in enumerate([h for h, _ in labelled] + own)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, bad) for i, (_, bad) in enumerate(labelled)] + [(len(labelled), None, None)], "doc_id long, quality int, toxic int")
    got = {r.host: r for r in hosts.filter_urls(pages, labels, rules=()).collect()}
    assert len(got) == len(labelled) + len(own)
    assert all(got[h].verdict == ("block" if bad else "allow") for h, bad in labelled)
    assert [got[h].verdict for h in own] == ["block", "block", "allow", "block", "block", "allow", "allow"]
    assert got["new.other.qq"].bound is None and got["new.bad.com"].bound == got["bad.com"].bound < got["a0.bad.com"].bound
    # labels of other hosts alone make the bounds of labelled hosts
    only = {r.host: r.bound for r in hosts.filter_urls(pages.where(f"page_id < {len(labelled)}"), labels, rules=()).collect()}
    assert all(got[h].bound == pytest.approx(b, rel=1e-12) for h, b in only.items())
