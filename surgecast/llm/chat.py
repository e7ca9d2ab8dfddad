"""Reply trees as chat texts: paths by self-joins, ranked branches, a reversible template; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """``text`` without any ``<|``: a backslash is doubled, then ``<|`` gets one inside."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    """The inverse of both: a backslash stands for what follows it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chain(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Linear conversations as trees: tree, node (1, 2, ...), parent, role, text, score.

    A turn replies to the one before it. Turns with one number are ordered by role and text,
    and null numbers come first. A conversation becomes one text, so its rows fit one task.
    """
    order = Window.partitionBy(conv).orderBy(F.col(turn).asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    node = F.row_number().over(order).cast("long")
    return rows.select(F.col(conv).alias("tree"), node.alias("node"), "role", "text", F.lit(0.0).alias("score")).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, depth) for every node on the way from every leaf (depth 0) up to its root.

    The known part of all paths doubles in each round: those who know their 2**r nearest
    ancestors look up the 2**r beyond them by a self-join on (tree, node). A parent that is
    missing ends a path; nodes on a circle hang on no root and give no path.
    """
    step = materialise(nodes.select("tree", "node", F.col("parent").alias("up")).dropDuplicates(["tree", "node"]), "up")
    present = step.select("tree", F.col("node").alias("up"))
    a, b = step.alias("a"), present.alias("b")
    step = a.join(b, F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.up") == F.col("b.up")), "left").select("a.tree", "a.node", F.col("b.up").alias("up"))
    step = materialise(step, "up")
    a, b = step.alias("a"), step.filter("up is not null").select("tree", F.col("up").alias("p")).distinct().alias("b")
    leaves = a.join(b, F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.node") == F.col("b.p")), "left_anti").select("tree", "node")
    known = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("depth"))
    jump, width = step, 1
    while True:
        k, j = known.alias("k"), jump.filter("up is not null").alias("j")
        more = k.join(j, F.col("k.tree").eqNullSafe(F.col("j.tree")) & (F.col("k.node") == F.col("j.node"))).select("k.tree", "k.leaf", F.col("j.up").alias("node"), (F.col("k.depth") + width).alias("depth"))
        more = materialise(more, "paths")
        if not more.limit(1).count():
            return known
        known = known.unionAll(more)
        # Nodes without an ancestor that far up leave the table, so its rounds add up to about twice its rows.
        a, b = jump.filter("up is not null").alias("a"), jump.filter("up is not null").alias("b")
        on = F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.up") == F.col("b.node"))
        jump = materialise(a.join(b, on).select("a.tree", "a.node", F.col("b.up").alias("up")), "up")
        width *= 2


def conversations(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """tree, leaf, rank, formatted, loss: the ``keep`` best branches of every tree as chat texts.

    ``nodes`` has tree, node, parent, role, text and score. A branch's score is the mean of
    its nodes'; null scores count zero and ties go to the smaller leaf. ``loss`` lists the
    (start, end) code points of each assistant text inside ``formatted``. Null roles and
    texts are empty; rows that repeat a node of their tree count once, the least in (role,
    text). Null trees are one tree. Other columns are ignored.
    """
    first = Window.partitionBy("tree", "node").orderBy(F.col("parent").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    nodes = nodes.select("tree", "node", "parent", "role", "text", "score").filter("node is not null").withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    nodes = materialise(nodes, "nodes")
    p, n = paths(nodes).alias("p"), nodes.alias("n")
    on = F.col("p.tree").eqNullSafe(F.col("n.tree")) & (F.col("p.node") == F.col("n.node"))
    scores = p.join(n.select("tree", "node", "score").alias("n"), on).groupBy("p.tree", "p.leaf").agg(F.avg(F.coalesce("n.score", F.lit(0.0))).alias("branch_score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf"))
    chosen = materialise(scores.withColumn("rank", rank).filter(F.col("rank") <= keep), "chosen").alias("c")
    picked = p.join(chosen, F.col("p.tree").eqNullSafe(F.col("c.tree")) & (F.col("p.leaf") == F.col("c.leaf"))).select("p.tree", "p.leaf", "p.node", "p.depth", "c.rank").alias("p")
    role, text = F.coalesce("n.role", F.lit("")), F.coalesce("n.text", F.lit(""))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    body = escape(text)
    turn = F.struct((-F.col("p.depth")).alias("at"), F.concat(head, body, F.lit(END + "\n")).alias("s"), F.length(head).alias("head"), F.length(body).alias("body"), (role == "assistant").alias("learn"))
    turns = picked.join(n, on).groupBy("p.tree", "p.leaf", "p.rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    tail = len(END) + 1
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(acc, t):
        start = acc["at"] + t["head"]
        span = F.array(F.struct(start.alias("start"), (start + t["body"]).alias("end")))
        none = F.array().cast("array<struct<start:int,end:int>>")
        return F.struct((start + t["body"] + tail).alias("at"), F.concat(acc["spans"], F.when(t["learn"], span).otherwise(none)).alias("spans"))

    loss = F.aggregate("turns", zero, add)["spans"]
    return turns.select("tree", "leaf", "rank", F.array_join(F.transform("turns", lambda t: t["s"]), "").alias("formatted"), loss.alias("loss"))


def parsed(formatted: Column) -> Column:
    """The (role, text) turns that a formatted conversation holds."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda s: s != "")
    # A role ends at its first line end without a backslash before it.
    role_of = lambda s: F.regexp_extract(s, r"^<\|im_start\|>((?:[^\\\n]|\\[\s\S])*+)\n", 1)
    return F.transform(pieces, lambda s: F.struct(unescape(role_of(s)).alias("role"), unescape(F.substring(s, F.length(role_of(s)) + len(START) + 2, F.length(s))).alias("text")))


def learnt(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(loss, lambda x: unescape(F.substring(formatted, x["start"] + 1, x["end"] - x["start"]))), "")
