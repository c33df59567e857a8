"""Conversations without an id, and nodes without one, come through."""

import pytest

pytest.importorskip("gridloom.llm")
from gridloom.llm import replytrees  # noqa: E402


def turns(df):
    out = df.withColumn("back", replytrees.read_turns(df.formatted)).withColumn("loss", replytrees.read_loss(df.formatted, df.loss_mask))
    return {(r.tree, r["rank"]): (r.leaf, r.n_turns, [tuple(t) for t in r.back], r.loss) for r in out.collect()}


def test_null_conversation(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 2, "user", "c"), (7, 0, "user", "d"), (7, 1, "assistant", "e"), (0, 0, "user", "f")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = replytrees.format_trees(replytrees.linear_nodes(df))
    assert dict(out.dtypes)["tree"] == "bigint" and dict(out.dtypes)["leaf"] == "bigint"
    assert turns(out) == {
        (None, 1): (3, 3, [("user", "a"), ("assistant", "b"), ("user", "c")], "b"),
        (7, 1): (2, 2, [("user", "d"), ("assistant", "e")], "e"),
        (0, 1): (1, 1, [("user", "f")], ""),
    }


def test_null_nodes_and_text_trees(spark):
    nodes = [(None, 1, None, "user", "r", 0.0), (None, None, 1, "assistant", "s", 5.0), (None, 2, 1, "assistant", "t", 1.0), ("x", None, None, "user", "u", 0.0), ("x", 4, None, "user", "v", 1.0)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    assert turns(replytrees.format_trees(df, best=3)) == {
        (None, 1): (None, 2, [("user", "r"), ("assistant", "s")], "s"),
        (None, 2): (2, 2, [("user", "r"), ("assistant", "t")], "t"),
        ("x", 1): (4, 1, [("user", "v")], ""),
        ("x", 2): (None, 1, [("user", "u")], ""),
    }
