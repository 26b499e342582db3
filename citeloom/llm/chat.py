"""Chat formatting over reply trees (operator 5), DataFrame operations only.

Messages form trees: a message names its parent. Root-to-leaf paths are
enumerated by self-joins that double the distance walked at each round
(pointer jumping), so a thread of depth d takes log2(d) joins. Paths are ranked
within a tree by score, and each chosen path becomes one conversation.

The template is ``<s>`` and then, for each turn, ``[INST]role[/INST]text</s>``.
Control strings inside roles and texts are escaped reversibly: every
backslash becomes ``\\b``, and a control string gets ``\\c`` after its first
character, so no control string is left in the escaped form and the two
replacements undo each other in reverse order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.llm.common import forget, materialise, text_of

BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = (BEGIN, END, OPEN, CLOSE)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for control in CONTROL:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\c" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\c"), F.lit("")), F.lit("\\b"), F.lit("\\"))


def keyed(messages: DataFrame) -> DataFrame:
    """messages with tree in a struct, which joins on a null tree as on any other."""
    return messages.withColumn("tree", F.struct("tree"))


def tree_paths(messages: DataFrame) -> DataFrame:
    """Root-to-leaf paths of messages(tree, node, parent, score).

    Returns (tree, leaf, node, up, score): up counts steps from the leaf. A
    message without a parent, or whose parent isn't in its tree, is a root.
    Messages on a cycle and those that hang on one reach no root, so they give
    no path. node must be unique in its tree. Messages of a null tree are one
    tree.
    """
    return _walk(keyed(messages)).withColumn("tree", F.col("tree.tree"))


def _walk(messages: DataFrame) -> DataFrame:
    nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("has"))
    links = nodes.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("has"), F.col("parent")).alias("parent"))
    links = materialise(links, "links")
    jumps, circling = _jumps(links)
    if circling is not None:
        cut = lambda df: materialise(df.join(circling, ["tree", "node"], "left_anti"), "rooted")
        links, jumps = cut(links), [cut(j) for j in jumps]
    parents = links.filter("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = links.join(parents, ["tree", "node"], "left_anti")
    # walked: after k rounds every node within 2^k - 1 steps of a leaf.
    walked = materialise(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up")), "walked")
    for k, jump in enumerate(jumps):
        further = walked.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + 2**k).alias("up"))
        before, walked = walked, materialise(walked.unionByName(further), "walked")
        forget(before, jump)
    return walked.join(nodes.select("tree", "node", "score"), ["tree", "node"])


def _jumps(links: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Jumps (tree, node, to) of 1, 2, 4, ... steps up links(tree, node, parent), and who walks in a circle, if any does.

    Jumps that would lead beyond a root are left out, so in trees they run out
    after log2(depth) rounds. Where some are left that are longer than any tree
    has messages, their messages (tree, node) never reach a root.
    """
    jump, out, most = links.filter("parent is not null").select("tree", "node", F.col("parent").alias("to")), [], None
    while True:
        jump = materialise(jump, "jump")
        if jump.isEmpty():
            return out, None
        out.append(jump)
        if most is None:
            most = links.groupBy("tree").count().agg(F.max("count")).first()[0]
        if 2 ** (len(out) - 1) > most:
            return out, jump.select("tree", "node")
        onward = jump.select("tree", F.col("node").alias("to"), F.col("to").alias("next"))
        jump = jump.join(onward, ["tree", "to"]).select("tree", "node", F.col("next").alias("to"))


def format_paths(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """Format the best paths of messages(tree, node, parent, role, text, score).

    Returns (tree, leaf, rank, score, formatted, loss): formatted is the
    conversation, loss the spans (start, length in characters, from 0) of the
    escaped assistant texts in it. A path scores the sum of its messages'
    scores; ties go to the smaller leaf. Null roles and texts count as empty.
    best=None keeps every path.
    """
    # Written once: threads are cut by a window, and the walk reads them again and again.
    messages = materialise(keyed(messages).select("tree", "node", "parent", "role", "text", "score"), "messages")
    paths = _walk(messages)
    if best is not None:
        scored = paths.groupBy("tree", "leaf").agg(F.sum("score").alias("total"))
        ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.col("total").desc(), F.col("leaf")))).filter(F.col("rank") <= best)
    else:
        scored = paths.groupBy("tree", "leaf").agg(F.sum("score").alias("total"))
        ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.col("total").desc(), F.col("leaf"))))
    chosen = paths.join(ranked, ["tree", "leaf"])
    text = messages.select("tree", "node", text_of("role").alias("role"), escape(text_of("text")).alias("body"))
    turns = chosen.join(text, ["tree", "node"]).select(
        "tree", "leaf", "rank", "total",
        F.struct((-F.col("up")).alias("at"), (F.col("role") == "assistant").alias("learn"), F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE)).alias("head"), "body").alias("turn"),
    )
    whole = turns.groupBy("tree", "leaf", "rank", "total").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    formatted = F.concat(F.lit(BEGIN), F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), ""))
    size = lambda t: F.length(t["head"]) + F.length(t["body"]) + F.lit(len(END))
    start = F.struct(F.lit(len(BEGIN)).alias("end"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate(
        "turns", start,
        lambda a, t: F.struct((a["end"] + size(t)).alias("end"), F.when(t["learn"], F.concat(a["spans"], F.array(F.struct((a["end"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))))).otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"],
    )
    return whole.select("tree.tree", "leaf", "rank", F.col("total").alias("score"), formatted.alias("formatted"), spans.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation, unescaped."""
    parts = F.split(F.substring(formatted, len(BEGIN) + 1, 2**31 - 1), END, -1)
    cut = F.slice(parts, F.lit(1), F.size(parts) - 1)
    bracket = F.lit(CLOSE)
    role = lambda p: F.substring(F.substring_index(p, CLOSE, 1), len(OPEN) + 1, 2**31 - 1)
    body = lambda p: F.substr(p, F.locate(CLOSE, p) + F.length(bracket))
    return F.transform(cut, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(body(p)).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between the spans."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def thread_messages(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Flat conversations as reply trees: each row replies to the row before it.

    Rows of one conversation go by turn, then role and text; a repeated turn
    is one more reply. The score of a row is its text's length.
    """
    c = conversations.select(conversations[conv_col].alias("tree"), conversations[turn_col].alias("turn"), conversations[role_col].alias("role"), conversations[text_col].alias("text"))
    order = W.partitionBy("tree").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    c = c.withColumn("node", F.row_number().over(order).cast("long"))
    return c.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.length(text_of("text")).cast("double").alias("score"))
