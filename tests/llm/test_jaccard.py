import random
import re

import pytest

pytest.importorskip("gridloom.llm")
from gridloom.llm import jaccard  # noqa: E402
from gridloom.llm.queries import QUERIES  # noqa: E402


def plain(rows):
    """(id, set size, smallest id reachable) by comparing all pairs."""
    sets = {}
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                ra, rb = sorted((root(a), root(b)))
                up[rb] = ra
    return sorted((i, len(sets[i]), root(i)) for i in ids)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()))


def test_against_all_pairs(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op6_jaccard_join"](spark, sf)) == plain(docs)


@pytest.mark.parametrize("at_once", [0, 5e7])
def test_families_and_edges(spark, monkeypatch, at_once):
    monkeypatch.setattr(jaccard, "AT_ONCE", at_once)
    rng = random.Random(2)
    word = lambda: "w%d" % rng.randrange(5000)
    rows = [(1000 + i, t) for i, t in enumerate([None, "", " \n", "a", "A ", "a b", "A B C D E", "a b c d e", "a b c d e f", "x" * 5000])]
    passage = [word() for _ in range(60)]
    for family in range(6):
        base = [word() for _ in range(rng.choice((40, 90, 200)))]
        if family % 2:
            base[10:10] = passage
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    rows += [(2000 + i, " ".join(passage + [word() for _ in range(rng.randrange(2, 60))])) for i in range(80)]
    monkeypatch.setattr(jaccard, "SMALL_BUCKET", 4)
    monkeypatch.setattr(jaccard, "LEADERS", (1, 2, 8, 512))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as component")
    assert got(jaccard.link_components(df)) == plain(rows)
    assert jaccard.link_components(df.limit(0)).count() == 0


def test_ids_and_names(spark):
    """Null and repeated ids, repeated rows, an id of several columns, columns with the operator's names."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, "one two three"), (1, "four"), (None, text + " more"), (None, "alone here"), (7, text), (7, text), (3, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as tokens", "3 as component_id", "4 as n")
    want = [(1, 56, 1), (1, 1, 1), (1, 1, 1), (None, 57, 1), (None, 1, None), (7, 56, 1), (7, 56, 1), (3, 0, 3), (3, 0, 3)]
    assert sorted(map(tuple, jaccard.link_components(df).collect()), key=repr) == sorted(want, key=repr)
    keyed = df.selectExpr("struct(doc_id is null as a, doc_id, text) as k", "text")
    out = jaccard.link_components(keyed, id_col="k").collect()
    assert {r.component_id for r in out if r.n_shingles in (56, 57)} == {(False, 1, text)}


def test_set_of_a_long_text():
    """Blocks cut texts between words; a word longer than a block stays whole."""
    rng = random.Random(5)
    words = ["w%d" % rng.randrange(9) for _ in range(300_000)] + ["y" * 600_000, "z"]
    texts = [" ".join(words).encode(), b"", b" a\tB ", ("x " * 1000).encode()]
    h, counts = jaccard.word_hashes(texts)
    assert counts.tolist() == [len(t.split()) for t in texts] and len(h) == counts.sum()
    flat = [w for t in texts for w in t.lower().split()]
    assert len({(a, b) for a, b in zip(flat, h.tolist(), strict=True)}) == len(set(flat)) == len(set(h.tolist()))


def test_rounds_follow_what_is_outside_of_the_largest_component(spark, monkeypatch):
    """Large buckets of one family and a few strangers are exhausted in one round, as the family's own pairs need no comparison."""
    rng = random.Random(3)
    word = lambda: "w%d" % rng.randrange(100_000)
    base, other = [word() for _ in range(64)], [word() for _ in range(64)]
    rows = [(i, " ".join([*base, word()])) for i in range(120)]
    rows += [(200 + i, " ".join([*other, word()])) for i in range(160)]
    rows += [(400 + i, " ".join([*base[:40], *other[i : i + 21]])) for i in range(4)]
    monkeypatch.setattr(jaccard, "LEADERS", (1, 2, 4, 8))
    monkeypatch.setattr(jaccard, "AT_ONCE", 20_000)  # 120 x 120 places in each of several buckets are more
    paths, write = [], jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, path: paths.append(path.rpartition("/")[2]) or write(df, path))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard.link_components(df)) == plain(rows)
    assert [x for x in paths if x.startswith("mixed")] == ["mixed1"] and "pairs1" in paths


@pytest.mark.parametrize("leaders", [1, 3, None])
def test_every_cross_pair_of_a_bucket(spark, leaders):
    """Pairs of different components, each once; all of them where the bucket is exhausted, whoever ranks first."""
    component = [7, 7, 5, 7, 5, 9, 7, 7, 7, 8, 9, 7]
    rows = [(1, i, 20, len(component), i + 1, c, 7, 9, 0 if leaders is None else 9) for i, c in enumerate(component)]
    df = spark.createDataFrame(rows, "token long, node long, n int, size long, rank int, component long, main long, kept long, open long").selectExpr("*", "0L as low", "0L as high")
    df = df.unionByName(df.withColumn("token", df.token + 1)).unionByName(df.withColumn("token", df.token + 2)).unionByName(df.withColumn("token", df.token + 3))
    need = jaccard.least_shared(20, 20)
    assert need <= 4
    want = [(a, b) for a, x in enumerate(component) for b, y in enumerate(component) if a < b and x != y and (leaders is None or a < leaders)]
    assert sorted(map(tuple, jaccard.cross_pairs(df, leaders).collect())) == want


def test_jobs_do_not_grow_with_partitions(spark):
    """The slices of the sketch are gathered in one job and not in one for each partition."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    rows = spark.createDataFrame([(i, f"a{i} b c d e f g") for i in range(40)], "id long, text string")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        sets = jaccard.set_rows(rows)
        spark.sparkContext.setJobGroup("sketch", "sketch")
        classes = jaccard.frequency_classes(sets)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("sketch"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert jobs <= 4 and any(classes)


def test_bits_lose_no_pair(spark):
    """With the bits of their tokens pairs are those that share enough tokens, and no bound is below what two sets share."""
    rng = random.Random(9)
    held = {i: set(rng.sample(range(1 << 40, (1 << 40) + 300), rng.choice((4, 9, 30, 120)))) for i in range(30)}
    held |= {30 + i: set(rng.sample(sorted(held[i % 30]), len(held[i % 30]) - i % 4)) for i in range(30)}
    rows = [(t, i, 20, 60, i + 1, i % 7, 3, len(s), 0) for i, s in held.items() for t in s]
    df = spark.createDataFrame(rows, "token long, node long, n int, size long, rank int, component long, main long, kept long, open long")
    df = df.join(df.groupBy("node").agg(jaccard._bits(False).alias("low"), jaccard._bits(True).alias("high")), "node")
    need = jaccard.least_shared(20, 20)
    want = [(a, b) for a in held for b in held if a < b and a % 7 != b % 7 and len(held[a] & held[b]) >= need]
    assert want and sorted(map(tuple, jaccard.cross_pairs(df, None).collect())) == want
    one = df.select("node", "kept", "low", "high").distinct()
    side = lambda k: one.select(*[one[c].alias(f"{c}_{k}") for c in one.columns])
    bounds = side("a").crossJoin(side("b")).select("node_a", "node_b", jaccard._most_shared("a", "b"))
    assert all(len(held[a] & held[b]) <= most for a, b, most in bounds.collect())
