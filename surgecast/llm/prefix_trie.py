"""A trie over the prefixes of conversations, with subtree totals rolled up by depth bands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Depths of one band: a node is copied to so many ancestors at most, and the bands of one
#: level are the depths of the next.
BAND = 8
#: Turns of one conversation that are summed in one task; a power of BAND.
BLOCK = BAND**4
#: Bits of each of the three running sums that name a node.
LANE = (1 << 42) - 1
#: Parts that the children of one node are dealt into to look up their parent.
SALT = 256
#: Ids of one end list that are joined in one go.
ENDS = 8_192

LANES = ("a", "b", "c")


def ordered_turns(convs: DataFrame) -> DataFrame:
    """conv_id, part, pos (from 1), n, hx, hy, chars: every turn, its conversation's turns, two hashes and the code points of its text.

    Turns are ordered by turn (null first), then role and text; null roles and texts are
    empty; rows without an id, or with one that is no whole number, belong to no
    conversation. Rows are sorted by ranges of (conversation, turn), so a conversation of
    any length is spread over tasks, and places in it are counted range by range.
    """
    empty = F.lit("")
    conv_id = F.expr("try_cast(conv_id as long)").alias("conv_id")
    rows = convs.select(conv_id, "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).filter("conv_id is not null")
    # Equal rows may be exchanged, so the number that lets a range cut between them is free.
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "tie"]
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    hx, hy = F.xxhash64("role", "text"), F.xxhash64("text", F.lit(1), "role")
    narrow = ranged.select("conv_id", hx.alias("hx"), hy.alias("hy"), F.length("text").cast("long").alias("chars"), F.monotonically_increasing_id().alias("at"))
    turns = materialise(narrow.withColumn("part", F.shiftright("at", 33)), "turns")
    spans = turns.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # One row for each conversation and range that holds some of it.
    whole = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("conv_id", "part", "first", before.alias("before"), F.sum("n").over(whole).alias("n"))
    pos = F.col("at") - F.col("first") + 1 + F.col("before")
    return turns.join(spans, ["conv_id", "part"]).select("conv_id", "part", pos.alias("pos"), "n", "hx", "hy", "chars")


def shared_openings(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that open like another: (conv_id, n) and their turns (conv_id, pos, n, hx, hy, chars).

    Conversation c takes the first h turns of conversation c - c % ``every`` (none if that
    is absent) in place of its own first h; h is the crc32 of c in decimals modulo ``most``.
    """
    turns = materialise(turns, "numbered")
    own = turns.filter("pos = 1").select("conv_id", "n")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    first = F.col("conv_id") - F.col("conv_id") % every
    bases = own.filter(first == F.col("conv_id")).select(F.col("conv_id").alias("base"), F.least("n", F.lit(most - 1).cast("long")).alias("has"))
    convs = own.select("conv_id", "n", h, first.alias("base")).join(bases, "base", "left")
    convs = convs.withColumn("copied", F.least("h", F.coalesce("has", F.lit(0).cast("long"))))
    convs = materialise(convs.select("conv_id", "base", "h", "copied", (F.col("copied") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), "openings")
    # A conversation has one row here for each range it lies in, so its turns stay spread.
    moved = turns.select("conv_id", "part").distinct().join(convs, "conv_id").select("conv_id", "part", "h", "copied", "n")
    kept = turns.drop("n").join(moved, ["conv_id", "part"]).filter("pos > h")
    kept = kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("copied")).alias("pos"), "n", "hx", "hy", "chars")
    opening = turns.filter((F.col("pos") < most) & (first == F.col("conv_id"))).select(F.col("conv_id").alias("base"), "pos", "hx", "hy", "chars")
    copies = convs.filter("copied > 0").join(opening, "base").filter("pos <= copied").select("conv_id", "pos", "n", "hx", "hy", "chars")
    return convs.select("conv_id", "n"), kept.unionAll(copies)


def _prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, pos, n, chars, tail, id, parent, path, up: the node of every prefix of every conversation.

    A node's id is the sum of hashes of (place, turn) along it, in three lanes, so its
    parent's is a difference, and blocks of a long conversation are summed apart and
    carried on. ``path`` holds the ancestors in its band, itself last, ``up`` the node a
    band higher where a band starts. The first turn of a block also ends the block before
    it, as ``tail``, where its ``up`` is known.
    """
    x, y = F.xxhash64("pos", "hx", "hy"), F.xxhash64("hy", "pos", "hx")
    lanes = [x.bitwiseAND(F.lit(LANE)).alias("a"), y.bitwiseAND(F.lit(LANE)).alias("b"), F.shiftleft(F.shiftrightunsigned(x, 42), 20).bitwiseOR(F.shiftrightunsigned(y, 44)).alias("c")]
    zero = F.lit(0).cast("long")
    tops = convs.select("conv_id", zero.alias("pos"), "n", zero.alias("chars"), *[zero.alias(c) for c in LANES])
    rows = turns.select("conv_id", "pos", "n", "chars", *lanes).unionAll(tops)
    block = F.floor(F.col("pos") / BLOCK)
    starts = (F.col("pos") > 0) & (F.col("pos") % BLOCK == 0)
    places = F.when(starts, F.array(block, block - 1)).otherwise(F.array(block))
    rows = rows.withColumn("block", F.explode(places)).withColumn("tail", F.col("block") < block)

    sums = rows.filter(~F.col("tail") & (F.col("n") >= BLOCK)).groupBy("conv_id", "block").agg(*[F.sum(c).bitwiseAND(F.lit(LANE)).alias(c) for c in LANES])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("conv_id", "block", *[F.coalesce(F.sum(c).over(earlier), zero).bitwiseAND(F.lit(LANE)).alias(f"_{c}") for c in LANES])

    along = Window.partitionBy("conv_id", "block").orderBy("pos")
    rows = rows.join(carry, ["conv_id", "block"], "left")
    for c in LANES:
        running = F.sum(c).over(along.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(f"_{c}", zero)
        rows = rows.withColumn(f"s{c}", running.bitwiseAND(F.lit(LANE)))
    node = F.struct(*[F.col(f"s{c}").alias(c) for c in LANES])
    above = F.struct(*[(F.col(f"s{c}") - F.col(c)).bitwiseAND(F.lit(LANE)).alias(c) for c in LANES])
    rows = rows.withColumn("id", node).withColumn("parent", F.when(F.col("pos") > 0, above))
    rows = rows.withColumn("up", F.when(F.col("pos") % BAND == 0, F.lag("id", BAND).over(along)))
    band = Window.partitionBy("conv_id", "block", F.floor(F.col("pos") / BAND)).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("conv_id", "pos", "n", "chars", "tail", "id", "parent", F.collect_list("id").over(band).alias("path"), "up")


def _band_starts(rows: DataFrame) -> DataFrame:
    """conv_id, pos, id, parent, path: the next level, of the prefixes at which a band of ``rows`` (conv_id, pos, id, up) starts."""
    tops = rows.select("conv_id", (F.col("pos") / BAND).cast("long").alias("pos"), "id", F.col("up").alias("parent"))
    # The start of a band closes the band before it, whose first node is a band higher.
    band = F.floor(F.col("pos") / BAND)
    both = F.when((F.col("pos") > 0) & (F.col("pos") % BAND == 0), F.array(band, band - 1)).otherwise(F.array(band))
    w = Window.partitionBy("conv_id", "band").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    path = F.collect_list("id").over(w)
    seen = tops.withColumn("band", F.explode(both)).withColumn("path", path).withColumn("closes", F.col("band") < band)
    return seen.withColumn("up", F.when(F.col("closes"), F.col("path")[0]))


def _summed(nodes: DataFrame) -> DataFrame:
    """Every node's leaves and saved tokens added to itself and its ancestors in its band."""
    return nodes.select(F.explode("path").alias("id"), "leaves", "saved").groupBy("id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _totals(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """id, leaves, saved over whole subtrees; ``nodes`` has id, parent, path and each node's own leaves and saved.

    What a band holds is added up at its root, the roots are nodes of the next level, whose
    totals are found in the same way, and a root's complete total is then added to its
    parent, at the bottom of the band above, before that band is summed.
    """
    if not levels:
        return _summed(nodes)
    own = nodes.groupBy(F.col("path")[0].alias("id")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    roots = levels[0].join(own, "id")
    complete = materialise(_totals(materialise(roots, "roots"), levels[1:]), "roots")
    below = complete.join(nodes.filter("parent is not null").select("id", "parent"), "id")
    below = below.groupBy(F.col("parent").alias("id")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    zero = F.lit(0).cast("long")
    more = nodes.join(below, "id", "left")
    return _summed(more.select("path", *[(F.col(c) + F.coalesce(f"_{c}", zero)).alias(c) for c in ("leaves", "saved")]))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of every node, fed piece by piece in order."""
    at, state = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in at] + [pa.array([state.hexdigest()])], names=[*LANES, "ends_sha256"])

    for batch in batches:
        done = []
        ids = list(zip(*[batch.column(c).to_pylist() for c in LANES]))
        for node, text in zip(ids, batch.column("ids").to_pylist()):
            if node != at:
                if at is not None:
                    done.append(row())
                at, state = node, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if at is not None:
        yield row()


def _ends(rows: DataFrame) -> DataFrame:
    """id, ends_sha256: digest of the ascending ids of the conversations that end at a node.

    Ids are joined in stretches of ``ENDS`` numbers, so the one task that must read a
    node's whole list in order reads few long rows and holds one of them.
    """
    stretch = F.floor(F.col("conv_id") / ENDS)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    lists = rows.groupBy("id", stretch.alias("stretch")).agg(ids.alias("ids")).select("id.*", "stretch", "ids")
    inorder = lists.repartition(*LANES).sortWithinPartitions(*LANES, "stretch").drop("stretch")
    return inorder.mapInArrow(_digest, "a long, b long, c long, ends_sha256 string").select(F.struct(*LANES).alias("id"), "ends_sha256")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the conversations, the empty one included.

    ``convs`` is (conv_id, n) and ``turns`` (conv_id, pos from 1, n, hx, hy, chars) as above.
    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. Prefixes are told apart by 126 bits of hashes. No
    conversations give no rows; one without turns is a member of the root.

    No step needs all turns, members or children of one node or conversation in one task:
    hot nodes are added up before they are shuffled, long conversations are cut into
    blocks, and children look their parent up in ``SALT`` parts. Only the digest of an end
    list is sequential. The number of levels is the logarithm of the deepest conversation.
    """
    deepest = convs.agg(F.max("n")).first()[0]
    rows = materialise(_prefixes(convs, turns), "prefixes")
    main = rows.filter("not tail")
    ends = F.col("pos") == F.col("n")
    nodes = main.groupBy("id").agg(
        F.min("conv_id").alias("conv_id"), F.max("pos").alias("depth"), F.count("*").alias("n_convs"), F.count_if(ends).alias("ends"),
        F.max("chars").alias("chars"), F.first("parent").alias("parent"), F.first("path").alias("path"),
    )
    leaves = (F.col("ends") == F.col("n_convs")).cast("long")
    nodes = materialise(nodes.withColumn("leaves", leaves).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), "nodes")

    levels, reach, starts = [], BAND, rows.filter((F.col("pos") % BAND == 0) & ((F.col("pos") == 0) | F.col("up").isNotNull()))
    while deepest is not None and reach <= deepest:
        seen = materialise(_band_starts(starts), "starts")
        level = seen.filter("not closes").groupBy("id").agg(F.first("parent", ignorenulls=True).alias("parent"), F.first("path").alias("path"))
        levels.append(level)
        starts = seen.filter((F.col("pos") % BAND == 0) & ((F.col("pos") == 0) | F.col("closes")))
        reach *= BAND
    totals = _totals(nodes, levels)

    salt = F.pmod(F.xxhash64("id"), F.lit(SALT)).alias("salt")
    children = nodes.filter("parent is not null").select("id", "parent", salt)
    parts = materialise(children.groupBy("parent", "salt").count(), "children")
    known = parts.join(nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    parents = children.join(known, ["parent", "salt"]).select("id", "parent_conv_id")
    counts = parts.groupBy(F.col("parent").alias("id")).agg(F.sum("count").alias("n_children"))

    each = nodes.select("id", "conv_id", "depth", "n_convs")
    facts = [totals.select("id", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")), parents, counts, _ends(main.filter(ends))]
    for fact in facts:
        each = each.unionByName(fact, allowMissingColumns=True)
    zero = F.lit(0).cast("long")
    found = each.groupBy("id").agg(*[F.max(c).alias(c) for c in each.columns if c != "id"])
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_trie(convs: DataFrame) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text); other columns are ignored."""
    turns = materialise(ordered_turns(convs), "numbered")
    return trie(turns.filter("pos = 1").select("conv_id", "n"), turns.drop("part"))
