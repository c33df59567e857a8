import hashlib

import duckdb
import pytest

pytest.importorskip("gridloom.llm")
from gridloom.llm import hosts, replytrees  # noqa: E402
from gridloom.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402


def view(con, sf, *names):
    for n in names:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf}/{n}.parquet'")


def test_url_filter_equals_sql(spark, sf):
    con = duckdb.connect()
    view(con, sf, "pages", "labels")
    want = sorted(map(tuple, con.execute("SELECT page_id, host, path, rule, verdict FROM (" + ORACLE_SQL["op7_url_filter"] + ")").fetchall()))
    got = sorted(tuple(r) for r in QUERIES["op7_url_filter"](spark, sf).collect())
    assert repr(got) == repr(want)


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.EXAMPLE.COM/en/7x?q", "x://example.com/en/8", "x://net/de/", "x://a.example.net/de/8#f", "x://org?x/es/", "x://é.ORG/es/\nq", "a://b://c/d", "x://notcom/en/", "x://com/en/1"]
    pages = spark.createDataFrame([(i, u, "html") for i, u in enumerate(urls)] + [(None, "x://com/en/", "h")], "page_id long, url string, host string")
    labels = spark.createDataFrame([(i, 0, 1) for i in range(4)] + [(None, 0, 1), (12, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in hosts.filter_urls(pages, labels, limit=0.2).collect()}
    assert got[0][:2] == got[1][:2] == got[2][:2] == got[3][:2] == ("", "") and got[0][3] == "block"
    assert got[4] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[5] == ("example.com", "/en/8", "com/en/", "block")
    assert got[6] == ("net", "/de/", "net/de/", "allow") and got[7] == ("a.example.net", "/de/8", "example.net/de/8", "block")
    assert got[8][:3] == ("org", "", None) and got[9][:3] == ("é.org", "/es/\nq", "org/es/")
    assert got[10][:2] == ("b:", "//c/d") and got[11] == ("notcom", "/en/", None, "allow") and got[None][3] == "block"
    assert hosts.filter_urls(pages.limit(0), labels).count() == 0
    assert hosts.filter_urls(pages, labels.limit(0)).where("verdict = 'block' and rule is null").count() == 0


def test_chat_round_trip(spark, sf):
    got = {r.conv_id: r for r in QUERIES["op8_chat_format"](spark, sf).collect()}
    rows = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        rows.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert set(got) == set(rows)
    for k, turns in rows.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[k].n_turns == len(turns)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_trees(spark):
    hard = "\\ \\\\<|turn|> <|text|><|end|> \\<| [/INST]</s>\n é<<||"
    nodes = [(1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", hard, 1.0), (1, 3, 1, "assistant", "b", 2.0), (1, 4, 2, "user", None, 5.0), (1, 5, 3, "us<|er\n", "d", 4.0),
             (2, 7, 99, "assistant", "orphan", None), (2, 7, 99, "assistant", "orphan", None), (3, 1, 2, "user", "ring", 0.0), (3, 2, 1, "user", "ring", 0.0), (3, 3, 1, "user", "below a ring", 0.0)]
    nodes += [(4, i, i - 1 if i else None, "assistant" if i % 2 else "user", str(i), 0.0) for i in range(70)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    out = replytrees.format_trees(df, best=2)
    out = out.withColumn("back", replytrees.read_turns(out.formatted)).withColumn("loss", replytrees.read_loss(out.formatted, out.loss_mask))
    got = {(r.tree, r["rank"]): r for r in out.collect()}
    assert sorted(got) == [(1, 1), (1, 2), (2, 1), (4, 1)]
    assert got[1, 1].leaf == 4 and [tuple(t) for t in got[1, 1].back] == [("user", "root"), ("assistant", hard), ("user", "")] and got[1, 1].loss == hard
    assert [tuple(t) for t in got[1, 2].back] == [("user", "root"), ("assistant", "b"), ("us<|er\n", "d")]
    assert got[2, 1].loss == "orphan" and [t.text for t in got[4, 1].back] == [str(i) for i in range(70)]
    assert got[1, 1].formatted.count("<|") == 9 and "</s>" not in got[1, 1].formatted
    assert replytrees.format_trees(df.limit(0)).count() == 0
