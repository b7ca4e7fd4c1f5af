"""Chat formatting of reply trees, in DataFrame operations only.

Root-to-leaf paths come from iterative self-joins that double the distance each time, branches are
ranked by score, and each chosen path is written as one conversation. The template marks turns,
and control strings inside texts are escaped so that the text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortframe.session import materialised

# The marks of the template.
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: What is escaped inside texts: the marks above and those of other common templates. The first
#: character of one is followed by a tilde; where tildes stand there already, by one more.
CONTROL = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>|/?INST\]"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(?=~*(?:{CONTROL}))", "$1~")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])~(?=~*(?:{CONTROL}))", "$1")


def _role(role: Column) -> Column:
    """A role as one line without marks; ``%`` starts an escape, so that it can be read back."""
    out = F.replace(F.coalesce(role, F.lit("")), F.lit("%"), F.lit("%25"))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def _role_read(role: Column) -> Column:
    out = F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n"))
    return F.replace(out, F.lit("%25"), F.lit("%"))


def reply_paths(nodes: DataFrame, tree: str, node: str, parent: str) -> DataFrame:
    """``tree, leaf, node, depth`` for every node on the path from a root to each leaf, roots at 0.

    ``tree`` and ``node`` together identify a row. A node whose parent is missing or unknown is a
    root. The paths double in length with each self-join, so a path of n turns takes log2(n)
    rounds. Parents that run in a circle raise ``ValueError``.
    """
    n = nodes.select(F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent"))
    known = n.select("tree", F.col("node").alias("parent"))
    inner = n.join(known, ["tree", "parent"], "left_semi")
    leaves = n.join(inner.select("tree", F.col("parent").alias("node")), ["tree", "node"], "left_anti")
    jumps = materialised(inner.select("tree", "node", F.col("parent").alias("up")))
    # Distance from the leaf; for each round all nodes nearer than 2 ** round are known.
    paths = materialised(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist")))
    largest = n.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while not jumps.isEmpty():
        if reach > largest:
            raise ValueError("the parents of a tree run in a circle")
        more = paths.join(jumps, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("dist") + reach).alias("dist"))
        paths = materialised(paths.unionAll(more))
        step = jumps.select("tree", F.col("node").alias("up"), F.col("up").alias("next"))
        jumps = materialised(jumps.join(step, ["tree", "up"]).select("tree", "node", F.col("next").alias("up")))
        reach *= 2
    if leaves.isEmpty() and largest:
        raise ValueError("the parents of a tree run in a circle")
    length = paths.groupBy("tree", "leaf").agg(F.max("dist").alias("last"))
    return paths.join(length, ["tree", "leaf"]).select("tree", "leaf", "node", (F.col("last") - F.col("dist")).alias("depth"))


def format_trees(
    nodes: DataFrame,
    tree: str,
    node: str,
    parent: str,
    role: str = "role",
    text: str = "text",
    score: str | None = None,
    branches: int | None = 1,
    assistant: str = "assistant",
) -> DataFrame:
    """``tree, leaf, rank, score, n_turns, formatted, loss_spans``: the best branches of each tree.

    A branch's score is the mean of its nodes' (a missing one counts 0; no score column: all 0);
    ties go to the smallest leaf. ``branches`` is how many are kept per tree, None for all.
    ``loss_spans`` are the places of the assistant's texts in ``formatted``, in code points, the
    end exclusive. Missing roles and texts are empty ones; an empty table gives no rows.
    Rows without a tree are one tree, whose name is missing; rows without a node are left out.
    Identical rows count once; other columns are left out. One of two different rows with the
    same tree and node is refused by ``ValueError``.
    """
    rows = materialised(
        nodes.select(
            # A missing tree is a tree of its own: wrapped up, it equals itself in joins.
            F.struct(F.col(tree).isNull().alias("none"), F.col(tree).alias("id")).alias("tree"),
            F.col(node).alias("node"), F.col(parent).alias("parent"),
            F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
            (F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)).alias("score"),
        ).where(F.col("node").isNotNull()).distinct()
    )
    if not rows.groupBy("tree", "node").count().where("count > 1").isEmpty():
        raise ValueError("two rows share a tree and a node")
    paths = reply_paths(rows, "tree", "node", "parent").join(rows.select("tree", "node", "role", "text", "score"), ["tree", "node"])
    ranked = paths.groupBy("tree", "leaf").agg(F.avg("score").alias("score"), F.count("*").alias("n_turns"))
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    ranked = ranked.withColumn("rank", F.row_number().over(order))
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    turn = F.concat(F.lit(START), _role(F.col("role")), F.lit(MIDDLE), escaped(F.col("text")), F.lit(END))
    head = F.length(F.concat(F.lit(START), _role(F.col("role")), F.lit(MIDDLE)))
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turns = (
        paths.drop("score")
        .join(ranked.select("tree", "leaf"), ["tree", "leaf"], "left_semi")
        .withColumns({"turn": turn, "head": head})
        .withColumn("at", F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.col("head"))
        .withColumn("end", F.col("at") + F.length("turn") - F.col("head") - len(END))
    )
    whole = turns.groupBy("tree", "leaf").agg(
        F.array_sort(F.collect_list(F.struct("depth", "turn"))).alias("turns"),
        F.array_sort(
            F.collect_list(F.when(F.col("role") == assistant, F.struct(F.col("at").alias("start"), "end")))
        ).alias("loss_spans"),
    )
    return whole.join(ranked, ["tree", "leaf"]).select(
        "tree.id", "leaf", "rank", "score", "n_turns",
        F.array_join(F.col("turns.turn"), "").alias("formatted"), "loss_spans",
    ).withColumnRenamed("id", "tree")


def turns_of(formatted: Column) -> Column:
    """The turns read back from a formatted conversation: an array of ``role, text``."""
    parts = F.slice(F.split(formatted, r"<\|im_end\|>\n"), 1, F.greatest(F.size(F.split(formatted, r"<\|im_end\|>\n")) - 1, F.lit(0)))
    return F.transform(
        parts,
        lambda p: F.struct(
            _role_read(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescaped(F.substr(p, F.locate("\n", p) + 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, without anything between the spans."""
    cut = lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return F.array_join(F.transform(spans, cut), "")


def with_parents(rows: DataFrame, conversation: str, turn: str, role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as trees that do not branch: ``conversation, node, parent, role, text``.

    Turns are numbered anew from 0; ties go by role and text, missing values first.
    """
    order = Window.partitionBy(conversation).orderBy(turn, role, text)
    numbered = rows.select(conversation, role, text, (F.row_number().over(order) - 1).alias("node"))
    return numbered.withColumn("parent", F.when(F.col("node") > 0, F.col("node") - 1))
