"""Chat formatting of reply trees, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uipatterns.llm.common import shared_folder, written

# Control strings of the template (fixed values).  All hold "<" or "[", which never stand unescaped in a text.
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|says|>", "<|end|>"


def escape(text: Column) -> Column:
    """Put a backslash behind every backslash, "<" and "[": no control string of any common template survives."""
    return F.regexp_replace(text, r"([\\<\[])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def root_paths(messages: DataFrame, folder: str) -> DataFrame:
    """(tree, leaf, node, above): every node on the way from a root to each leaf.

    ``messages`` has tree, node, parent (null at a root), unique by (tree,
    node).  Self-joins double the pointers: round k joins each pointer over
    2^k levels with itself, so a chain of d messages takes log2(d) rounds.
    Then each leaf collects its ancestors, once each, by the binary digits of
    their distance.  ``above`` counts the levels between node and leaf.
    Nodes whose ancestors form a cycle, or lack a root, belong to no path.
    """
    nodes = messages.select("tree", "node", "parent")
    jumps = [written(nodes.filter("parent is not null").select("tree", "node", F.col("parent").alias("up")), folder, "jump0")]
    # No pointer is longer than its tree, but for cycles: those would double for ever.
    deepest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while 2 ** len(jumps) < deepest:
        last = jumps[-1]
        step = written(
            last.alias("a").join(last.alias("b"), (F.col("a.tree") == F.col("b.tree")) & (F.col("a.up") == F.col("b.node")))
            .select("a.tree", "a.node", "b.up"), folder, f"jump{len(jumps)}")
        if step.isEmpty():
            break
        jumps.append(step)
    has_child = jumps[0].select("tree", F.col("up").alias("node")).distinct()
    reach = nodes.join(has_child, ["tree", "node"], "left_anti").select(
        "tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above"))
    for k in reversed(range(len(jumps))):
        up = jumps[k].toDF("tree", "node", "next")
        more = reach.join(up, ["tree", "node"]).select("tree", "leaf", F.col("next").alias("node"), (F.col("above") + F.lit(2 ** k)).alias("above"))
        reach = written(reach.unionByName(more), folder, f"reach{k}")
    rooted = reach.join(nodes.filter("parent is null").select("tree", "node"), ["tree", "node"], "left_semi").select("tree", "leaf")
    return reach.join(rooted, ["tree", "leaf"], "left_semi")


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(MIDDLE), escape(text), F.lit(CLOSE))


def format_trees(
    messages: DataFrame, branches: int | None = None, learn: str = "assistant", folder: str | None = None,
) -> DataFrame:
    """One formatted conversation for each chosen root-to-leaf path.

    ``messages``: tree, node, parent, role, text and, if there, score.
    Paths of a tree are ranked by their mean score (null: 0), ties by more
    messages, then by the smaller leaf; ``branches`` keeps the best so many,
    None keeps all.  Returns tree, branch (from 1), leaf, path_score, n_turns,
    formatted, loss (array of [start, stop) code points whose text the model
    learns: the escaped texts of role ``learn``).

    Nulls: a null text or role is empty; null is a tree like any other; rows
    without node take no part (nothing can refer to them).  Of rows that repeat (tree, node) the
    smallest (parent, role, text) counts.  Missing parents and cycles: no
    path.  Extra columns are ignored.  Empty table: empty result.
    """
    folder = folder or shared_folder(messages.sparkSession, "chat")
    score = F.col("score").cast("double") if "score" in messages.columns else F.lit(0.0)
    # Joins and groups see a struct, which is never null, so null is a tree of its own.
    tree = F.struct(F.col("tree").isNull().alias("none"), F.col("tree").alias("id")).alias("tree")
    rows = messages.filter("node is not null").select(
        tree, "node", F.struct("parent", F.coalesce("role", F.lit("")).alias("role"),
                                 F.coalesce("text", F.lit("")).alias("text"), F.coalesce(score, F.lit(0.0)).alias("score")).alias("m"))
    rows = written(rows.groupBy("tree", "node").agg(F.min("m").alias("m")).select("tree", "node", "m.*"), folder, "messages")
    paths = root_paths(rows, folder)
    if branches is not None:
        ranked = paths.join(rows.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(
            F.avg("score").alias("s"), F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("tree").orderBy(F.desc("s"), F.desc("n"), "leaf")
        chosen = ranked.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= branches).select("tree", "leaf")
        paths = paths.join(chosen, ["tree", "leaf"], "left_semi")
    told = paths.join(rows.select("tree", "node", "role", "score", turn_text(F.col("role"), F.col("text")).alias("t")), ["tree", "node"])
    one = F.struct((-F.col("above")).alias("k"), "t", F.length(F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))).alias("head"),
                   (F.col("role") == learn).alias("learn"))
    whole = told.groupBy("tree", "leaf").agg(
        F.avg("score").alias("path_score"), F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(one)).alias("turns"))
    # Where each turn starts, by running over the turns of the path.
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))
    tail = len(CLOSE)

    def step(acc, x):
        end = acc["at"] + F.length(x["t"])
        span = F.struct((acc["at"] + x["head"]).alias("start"), (end - tail).alias("stop"))
        return F.struct(end.alias("at"), F.when(x["learn"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    out = whole.select(
        "tree", "leaf", "path_score", "n_turns", F.array_join(F.transform("turns", lambda x: x["t"]), "").alias("formatted"),
        F.aggregate("turns", zero, step)["spans"].alias("loss"))
    order = Window.partitionBy("tree").orderBy(F.desc("path_score"), F.desc("n_turns"), "leaf")
    return out.select(F.col("tree.id").alias("tree"), F.row_number().over(order).alias("branch"), "leaf", "path_score", "n_turns", "formatted", "loss")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    inner = F.split(formatted, r"<\|end\|>", -1)
    turns = F.slice(inner, 1, F.greatest(F.size(inner) - 1, F.lit(0)))

    def parse(t):
        both = F.split(F.substring(t, len(OPEN) + 1, 2147483647), r"<\|says\|>", -1)
        return F.struct(unescape(both[0]).alias("role"), unescape(both[1]).alias("text"))

    return F.transform(turns, parse)


def learned_text(formatted: Column, loss: Column) -> Column:
    """What stands under the loss mask, unescaped, one part behind the other."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["stop"] - s["start"]))), "")


def as_trees(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees: each row answers the one before it.

    Rows of one turn number follow each other by role, then text; repeated
    rows are separate turns; a null turn comes first.  A null conv_id is a conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text")
