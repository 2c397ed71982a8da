"""Conversations as reply trees: root-to-leaf paths by iterative self-joins, ranked, and formatted with a loss mask.

Everything is DataFrame expressions. Paths are found by pointer doubling: each self-join doubles the distance a node's
pointer spans, so a chain of n replies takes log n joins, and a chosen path is unrolled the same way backwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from airzone.llm.common import let, only
from airzone.sources.tables import stage

#: The control strings around a turn's text, by role. Other roles are written between the role marks.
OPEN = {"user": "[INST]", "system": "<<SYS>>", "assistant": "<s>"}
CLOSE = {"user": "[/INST]", "system": "<</SYS>>", "assistant": "</s>"}
ROLE, ROLE_END = "[ROLE]", "[/ROLE]"
#: What follows the first character of a control string.
TAILS = r"s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|/ROLE\]"


def escaped(text: Column) -> Column:
    """Text that holds no control string: backslashes doubled, then one set behind the first character of each.

    A control string's first character is then followed by exactly one backslash, which doubling alone never makes.
    """
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"([<\[])(?={TAILS})", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, rf"([<\[])\\(?={TAILS})", "$1"), F.lit("\\\\"), F.lit("\\"))


def formatted_turn(role: Column, text: Column) -> Column:
    role, body = F.coalesce(role, F.lit("")), escaped(F.coalesce(text, F.lit("")))
    out = F.concat(F.lit(ROLE), escaped(role), F.lit(ROLE_END), body, F.lit(CLOSE["assistant"]))
    for known in OPEN:
        out = F.when(role == known, F.concat(F.lit(OPEN[known]), body, F.lit(CLOSE[known]))).otherwise(out)
    return out


_ANY_TURN = "|".join([r"\[INST\].*?\[/INST\]", r"<<SYS>>.*?<</SYS>>", r"<s>.*?</s>", r"\[ROLE\].*?</s>"])


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation as (role, text), as they were before formatting."""
    def turn(raw: Column) -> Column:
        out = F.struct(unescaped(F.regexp_extract(raw, r"(?s)^\[ROLE\](.*?)\[/ROLE\]", 1)).alias("role"),
                       unescaped(F.regexp_extract(raw, r"(?s)^\[ROLE\].*?\[/ROLE\](.*)</s>$", 1)).alias("text"))
        for role in OPEN:
            inner = F.substring(raw, F.lit(len(OPEN[role]) + 1), F.length(raw) - len(OPEN[role]) - len(CLOSE[role]))
            out = F.when(raw.startswith(OPEN[role]), F.struct(F.lit(role).alias("role"), unescaped(inner).alias("text"))).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(formatted, F.lit(f"(?s)({_ANY_TURN})"), F.lit(0)), turn)


def best_paths(nodes: DataFrame, per_root: int = 1, most: int = 40) -> DataFrame:
    """(path, root, rank, score, depth, node) of every node on the ``per_root`` best root-to-leaf paths of each root.

    ``nodes`` has node, parent and score. A node whose parent is null or missing is a root; a path is named by its
    leaf and scored by the sum of its nodes' scores, null as 0; ties go to the smaller leaf. Nodes on a cycle have
    no root and are left out. Rows with a null or repeated node count once.
    """
    own = nodes.where("node IS NOT NULL").groupBy("node").agg(F.min("parent").alias("parent"), F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    own = stage(own, "reply-nodes")
    there = own.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    # up: the node 2**level steps above, or null beyond the root; top, sum and steps: of the stretch up to there
    now = own.join(there, "parent", "left").select(
        "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.col("node").alias("top"), "score", F.lit(1).cast("long").alias("steps"))
    levels, before = [stage(now, "reply-level")], None
    for _ in range(most):
        now = levels[-1]
        waiting = now.where("up IS NOT NULL").count()
        # while a tree is open, each round reaches the root from some node: one that does not leaves cycles only
        if waiting in (0, before):
            break
        before = waiting
        above = now.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("score").alias("score2"), F.col("steps").alias("steps2"))
        # only nodes still below their root are joined
        longer = now.where("up IS NOT NULL").join(above, "up").select(
            "node", F.col("up2").alias("up"), F.col("top2").alias("top"), (F.col("score") + F.col("score2")).alias("score"),
            (F.col("steps") + F.col("steps2")).alias("steps"))
        levels.append(stage(longer.unionByName(now.where("up IS NULL")), "reply-level"))
    whole = levels[-1].where("up IS NULL")
    parents = own.select(F.col("parent").alias("node")).where("node IS NOT NULL").distinct()
    leaves = whole.join(parents, "node", "left_anti")
    ranked = (leaves.withColumn("rank", F.row_number().over(Window.partitionBy("top").orderBy(F.desc("score"), "node")))
              .where(F.col("rank") <= per_root)
              .select(F.col("node").alias("path"), F.col("top").alias("root"), "rank", "score", "node", "steps"))
    # unroll: a stretch of `steps` nodes upwards from `node` is cut at half the next level's span
    parts = stage(ranked.withColumn("depth", F.col("steps") - 1), "reply-paths")
    for level in range(len(levels) - 2, -1, -1):
        jump = levels[level].select("node", "up")
        span = 1 << level
        cut = parts.where(F.col("steps") > span)
        upper = cut.join(jump, "node").where("up IS NOT NULL").select(
            "path", "root", "rank", "score", F.col("up").alias("node"), (F.col("steps") - span).alias("steps"), (F.col("depth") - span).alias("depth"))
        lower = parts.withColumn("steps", F.least("steps", F.lit(span).cast("long")))
        parts = stage(lower.unionByName(upper), "reply-paths")
    return parts.select("path", "root", "rank", "score", "depth", "node")


def conversations_as_nodes(df: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply nodes, each turn the reply to the one before.

    Turns are ordered by turn number, then role and text, nulls first, so repeated turns are turns of their own. The
    node is the conversation's id and the place in it.
    """
    df = only(df, conv_id=df["conv_id"].cast("long"), turn="turn", role="role", text="text")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = df.withColumn("place", F.row_number().over(order))
    node = lambda place: F.struct(F.col("conv_id").alias("conv"), place.cast("long").alias("place"))
    return placed.select("conv_id", "role", "text", node(F.col("place")).alias("node"),
                         F.when(F.col("place") > 1, node(F.col("place") - 1)).alias("parent"), F.lit(0.0).alias("score"))


def formatted_paths(nodes: DataFrame, per_root: int = 1) -> DataFrame:
    """(path, root, rank, score, formatted): every chosen path of reply nodes (node, parent, score, role, text) as one text."""
    nodes = stage(nodes, "replies")
    paths = best_paths(nodes, per_root)
    turns = paths.join(nodes.select("node", "role", "text"), "node").select(
        "path", "root", "rank", "score", F.struct("depth", formatted_turn(F.col("role"), F.col("text")).alias("turn")).alias("t"))
    return (turns.groupBy("path", "root", "rank", "score").agg(F.array_sort(F.collect_list("t")).alias("turns"))
            .select("path", "root", "rank", "score", F.array_join(F.col("turns.turn"), "").alias("formatted")))


def digests(formatted: DataFrame, text_col: str = "formatted") -> DataFrame:
    """Counts and digests of the turns read back from ``text_col``; the loss mask covers the texts of the assistant."""
    keep = [c for c in formatted.columns if c != text_col]
    read = formatted.select(*keep, F.length(text_col).cast("long").alias("formatted_chars"), parsed(F.col(text_col)).alias("turns"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return read.select(*keep, F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def formatted_conversations(df: DataFrame) -> DataFrame:
    """(conv_id, formatted, ...) of every conversation: its one path as text, with the counts and digests read back from it.

    Null text and null role count as empty. Rows with a null conv_id are one conversation of that id. Repeated turns
    stay. An empty table gives no row.
    """
    paths = formatted_paths(conversations_as_nodes(df))
    return digests(paths.select(F.col("path.conv").alias("conv_id"), "formatted"))
