"""Reply trees to training conversations, with DataFrame operations only.

Root-to-leaf paths come from self-joins that double their reach each round: a
table of ancestors 2^k levels up is joined with itself, and the (leaf, node)
pairs found so far are joined with it.  After log2(depth) rounds every leaf has
its whole path, and the pairs are as many rows as the paths have.  Branches are
ranked by their summed score within a tree and each chosen path becomes one
formatted conversation with a loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.runtime import scratch_dir, written

#: Control strings of the template, and all strings that are escaped inside texts.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]")


def escape(x: Column) -> Column:
    """Doubles backslashes, then puts one after the first character of each control string."""
    x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        x = F.replace(x, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return x


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def branch_pairs(nodes: DataFrame, path: str) -> DataFrame:
    """(tree, leaf, node, up) for every node on the path of every leaf; ``up`` is its distance from the leaf.

    A parent that is not in the tree makes its child a root.  Leaves whose
    ancestors form a ring have no root and get no path.
    """
    ids = nodes.select("tree", "node", "parent")
    known = ids.select("tree", F.col("node").alias("parent")).distinct()
    up = written(ids.join(known, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("above")).distinct(), f"{path}/up0")
    leaves = ids.select("tree", "node").distinct().join(up.select("tree", F.col("above").alias("node")).distinct(), ["tree", "node"], "left_anti")
    pairs = written(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), f"{path}/pairs0")
    largest = ids.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    k = 0
    while (1 << k) <= largest and not up.isEmpty():
        step = pairs.join(up, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        pairs = written(pairs.unionByName(step), f"{path}/pairs{k + 1}")
        higher = up.select("tree", F.col("node").alias("above"), F.col("above").alias("top"))
        up = written(up.join(higher, ["tree", "above"]).select("tree", "node", F.col("top").alias("above")), f"{path}/up{k + 1}")
        k += 1
    if not up.isEmpty():
        ring = pairs.join(up, ["tree", "node"], "left_semi").select("tree", "leaf").distinct()
        pairs = pairs.join(ring, ["tree", "leaf"], "left_anti")
    return pairs


def format_trees(nodes: DataFrame, *, best: int = 1, trained_role: str = "assistant") -> DataFrame:
    """One row per chosen path: tree, leaf, rank, score, n_turns, formatted, loss_mask.

    ``nodes`` has tree, node, parent (null at a root), role, text and score; other
    columns are ignored.  The ``best`` paths of a tree by summed score (ties: the
    smaller leaf) are kept.  ``formatted`` marks every turn and escapes control
    strings inside roles and texts; ``loss_mask`` holds the code-point spans of
    the texts of ``trained_role``.  Null texts and roles are empty, null scores 0;
    rows of a null tree are one tree, a null node is a leaf, as no parent names it;
    repeated (tree, node) rows keep the smallest (role, text); no rows give none.
    """
    spark = nodes.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    # a struct equals another with the same null inside, so no join loses a null tree or node
    key = lambda c: F.struct(F.col(c).alias("v"))
    src = nodes.select(key("tree").alias("tree"), key("node").alias("node"), F.when(F.col("parent").isNotNull(), key("parent")).alias("parent"), text("role").alias("role"), text("text").alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    src = src.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("s")).select("tree", "node", "s.*")
    path = scratch_dir(spark)
    src = written(src, f"{path}/nodes")
    pairs = branch_pairs(src, path)
    scored = pairs.join(src.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum("score").alias("score"), F.count("*").alias("n_turns"))
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    chosen = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    rows = pairs.join(chosen, ["tree", "leaf"]).join(src.select("tree", "node", "role", "text"), ["tree", "node"])
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    rows = rows.select("tree", "leaf", "rank", "score", "n_turns", "up", (F.col("role") == trained_role).alias("trained"), head.alias("head"), escape(F.col("text")).alias("body"))
    down = Window.partitionBy("tree", "leaf").orderBy(F.desc("up"))
    size = F.length("head") + F.length("body") + len(END)
    rows = rows.withColumn("stop", F.sum(size).over(down) - len(END)).withColumn("piece", F.concat("head", "body", F.lit(END)))
    turns = F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "trained", "stop", F.length("body").cast("long").alias("n"), "piece")))
    out = rows.groupBy("tree", "leaf", "rank", "score", "n_turns").agg(turns.alias("turns"))
    mask = F.transform(F.filter("turns", lambda t: t.trained), lambda t: F.struct((t.stop - t.n).alias("start"), t.stop.alias("end")))
    return out.select(F.col("tree.v").alias("tree"), F.col("leaf.v").alias("leaf"), "rank", "score", "n_turns", F.array_join(F.transform("turns", lambda t: t.piece), "").alias("formatted"), mask.alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    parts = F.split(formatted, r"<\|end\|>")
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(p: Column) -> Column:
        fields = F.split(F.substring(p, len(TURN) + 1, 2**31 - 1), r"<\|text\|>")
        return F.struct(unescape(fields[0]).alias("role"), unescape(fields[1]).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(mask, lambda m: unescape(formatted.substr((m.start + 1).cast("int"), (m.end - m.start).cast("int")))), "")


def linear_nodes(conversations: DataFrame) -> DataFrame:
    """Nodes of plain conversations (conv_id, turn, role, text): each row replies to the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.row_number().over(w).cast("long")
    return conversations.select("conv_id", "turn", "role", "text").select(F.col("conv_id").alias("tree"), at.alias("node"), "role", "text").select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
