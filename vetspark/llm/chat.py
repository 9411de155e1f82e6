"""Chat formatting: reply trees to conversations, with a loss mask."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Fixed values of the template: what opens a turn, separates its role from its text, and ends it.
TURN, SAID, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Control strings that a text may hold, and their escaped forms.
CONTROL = {
    "<|": "<\\|",
    "<s>": "<\\s>",
    "</s>": "<\\/s>",
    "[INST]": "[\\INST]",
    "[/INST]": "[\\/INST]",
    "<<SYS>>": "<\\<SYS>>",
    "<</SYS>>": "<\\</SYS>>",
}


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one after the first character of every control string; null becomes empty."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for plain, safe in CONTROL.items():
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def unescape(text: Column) -> Column:
    """What :func:`escape` was given: a backslash makes way for the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear_tree(messages: DataFrame, tree: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages in a line as reply trees without branches: each answers the row before it.

    Rows are numbered by ``order`` (null first), then role and text; repeated rows stay.  Returns
    (tree, node, parent, role, text, score): score 0.
    """
    n = F.row_number().over(Window.partitionBy("tree").orderBy("o", "role", "text")).cast("long")
    rows = messages.select(F.col(f"`{tree}`").alias("tree"), F.col(f"`{order}`").alias("o"), F.col(f"`{role}`").cast("string").alias("role"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.select("tree", n.alias("node"), F.when(n > 1, n - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def branch_paths(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """Root-to-leaf paths of reply trees: (tree, leaf, node, depth), depth 0 at the root.

    ``nodes`` has (tree, node, parent, score).  Self-joins double the reach in
    every round: after k of them ``jump`` leads 2^k replies up, and every leaf
    knows its ancestors less than 2^k away, so that n replies in a line take log2(n) rounds.
    Branches are ranked by mean score along the path (null counts 0), then longer first, then smaller leaf;
    the ``best`` of each tree stay (None: all).  A row whose parent is
    missing is a root.  Rows in a cycle, and what hangs on one, have no root and are left out.
    Repeated node numbers in a tree: the first by parent (null first), then score, stays.  No rows give no rows.
    """
    own = nodes.groupBy("tree", "node").agg(F.min(F.struct(F.coalesce("parent", F.lit(-(2**63))).alias("p"), F.coalesce("score", F.lit(0.0)).alias("score"))).alias("s"))
    own = own.filter("node is not null").select("tree", "node", F.when(F.col("s.p") != -(2**63), F.col("s.p")).alias("parent"), "s.score")
    keys = own.select(F.col("tree").alias("k_tree"), F.col("node").alias("k_node"))
    known = F.col("tree").eqNullSafe(F.col("k_tree")) & (F.col("parent") == F.col("k_node"))
    own = materialise(own.join(keys, known, "left").select("tree", "node", F.col("k_node").alias("parent"), "score"), "chat-nodes")
    answered = own.select(F.col("tree").alias("k_tree"), F.col("parent").alias("k_node")).filter("k_node is not null").distinct()
    leaf = own.join(answered, F.col("tree").eqNullSafe(F.col("k_tree")) & (F.col("node") == F.col("k_node")), "left_anti")
    path = leaf.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    jump = own.filter("parent is not null").select(F.col("tree").alias("j_tree"), F.col("node").alias("j_node"), F.col("parent").alias("j_up"))
    reach = F.col("tree").eqNullSafe(F.col("j_tree")) & (F.col("node") == F.col("j_node"))
    n = own.count()
    for k in itertools.count():
        jump = materialise(jump, "chat-jump")
        further = path.join(jump, reach).select("tree", "leaf", F.col("j_up").alias("node"), (F.col("up") + 2**k).alias("up"))
        further = materialise(further, "chat-path")
        if further.isEmpty():
            break
        if 2**k > n:  # no path is that long: what goes on runs in a cycle
            lost = further.select(F.col("tree").alias("k_tree"), F.col("leaf").alias("k_leaf")).distinct()
            path = path.join(lost, F.col("tree").eqNullSafe(F.col("k_tree")) & (F.col("leaf") == F.col("k_leaf")), "left_anti")
            break
        path = path.unionByName(further)
        onward = jump.select(F.col("j_tree").alias("o_tree"), F.col("j_node").alias("o_node"), F.col("j_up").alias("o_up"))
        jump = jump.join(onward, F.col("j_tree").eqNullSafe(F.col("o_tree")) & (F.col("j_up") == F.col("o_node"))).select("j_tree", "j_node", F.col("o_up").alias("j_up"))
    scored = path.join(own.select(F.col("tree").alias("k_tree"), F.col("node").alias("k_node"), "score"), F.col("tree").eqNullSafe(F.col("k_tree")) & (F.col("node") == F.col("k_node")))
    branch = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("score"), F.count("*").alias("length"))
    if best is not None:
        rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("length"), "leaf"))
        branch = branch.withColumn("rank", rank).filter(F.col("rank") <= best)
    branch = branch.select(F.col("tree").alias("b_tree"), F.col("leaf").alias("b_leaf"), "length")
    return path.join(branch, F.col("tree").eqNullSafe(F.col("b_tree")) & (F.col("leaf") == F.col("b_leaf"))).select("tree", "leaf", "node", (F.col("length") - 1 - F.col("up")).alias("depth"))


def format_paths(paths: DataFrame, nodes: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One conversation per path: (tree, leaf, formatted, loss).

    ``formatted`` is the escaped turns between the template's marks; ``loss``
    lists the spans of it that are trained on (start from 0, length, in code points): the
    texts of the roles ``trained``.  Null roles and texts are empty.
    """
    said = nodes.select(F.col("tree").alias("n_tree"), F.col("node").alias("n_node"), "role", "text")
    rows = paths.join(said, F.col("tree").eqNullSafe(F.col("n_tree")) & (F.col("node") == F.col("n_node")))
    turn = F.struct("depth", escape(F.col("role")).alias("r"), escape(F.col("text")).alias("t"), F.coalesce(F.col("role").isin(*trained), F.lit(False)).alias("on"))
    talks = rows.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    formatted = F.concat_ws("", F.transform("turns", lambda x: F.concat(F.lit(TURN), x["r"], F.lit(SAID), x["t"], F.lit(END))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))
    def step(acc: Column, x: Column) -> Column:
        text_at = acc["at"] + F.length(x["r"]) + len(TURN) + len(SAID)
        span = F.array(F.struct(text_at.cast("long").alias("start"), F.length(x["t"]).cast("long").alias("length")))
        return F.struct((text_at + F.length(x["t"]) + len(END)).cast("long").alias("at"), F.when(x["on"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))
    return talks.select("tree", "leaf", formatted.alias("formatted"), F.aggregate("turns", start, step)["spans"].alias("loss"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(unescape(F.substring_index(F.substring(x, len(TURN) + 1, 2**31 - 1), SAID, 1)).alias("role"), unescape(F.substring_index(x, SAID, -1)).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """Unescaped text under the loss mask, read back from a formatted conversation."""
    return F.concat_ws("", F.transform(loss, lambda x: unescape(F.substring(formatted, (x["start"] + 1).cast("int"), x["length"].cast("int")))))


def format_conversations(messages: DataFrame, tree: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Formats messages that stand in a line: one conversation (tree, leaf, formatted, loss) per ``tree``.

    A null ``tree`` is one conversation of its own; other columns are ignored; no rows give no rows.

    A conversation is one row of text, so all rows of one ``tree`` meet in a task; rows without a tree are one conversation of their own.
    """
    nodes = materialise(linear_tree(messages, tree, order, role, text), "chat-said")
    return format_paths(branch_paths(nodes), nodes)
