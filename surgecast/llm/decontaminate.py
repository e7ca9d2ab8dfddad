"""Benchmark passages in documents by SimHash windows and exact shingle similarity; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_key, materialise

SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints have 2 x 64 bits; 32 blocks of four bits find everything within 31 bits.
RADIUS = 31
BLOCKS = RADIUS + 1
#: Benchmark shingles, or keys of suspect documents, that are sent to all executors at once; a row has two or three numbers.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def _shingles(words: Column, k: int) -> Column:
    """Structs of k consecutive words, NULL in the last places of the final k - 1."""
    if k == 1:
        return F.transform(words, lambda w: F.struct(w.alias("0")))
    n = F.size(words)
    return F.arrays_zip(*[F.slice(words, i + 1, F.greatest(n - i, F.lit(0))).alias(str(i)) for i in range(k)])


def _exploded(rows: DataFrame, keep: list[str], k: int) -> DataFrame:
    """``keep``, pos and hash of every k-word shingle of ``words``."""
    out = rows.select(*keep, F.posexplode(_shingles(F.col("words"), k)).alias("pos", "s"))
    parts = [F.col(f"s.`{i}`") for i in range(k)]
    return out.filter(parts[-1].isNotNull()).select(*keep, "pos", F.xxhash64(*parts).alias("hash"))


def _fingerprints(windows: DataFrame, keys: list[str], lane: int = 16) -> DataFrame:
    """keys, size, fp0 and fp1 of each window, a list ``hashes`` of its word hashes.

    Each bit counts its words in a lane of 16 or 32 bits, so 32 or 64 sums hold the 128
    counters and a window may have 2 ** (lane - 1) - 1 words.
    """
    exploded = windows.select(*keys, F.size("hashes").alias("size"), F.explode("hashes").alias("h0")).withColumn("h1", F.xxhash64("h0", F.lit(1)))
    lanes = F.lit(sum(1 << i for i in range(0, 64, lane)))
    sums = [F.sum(F.shiftrightunsigned(f"h{w}", j).bitwiseAND(lanes)).alias(f"s{w}_{j}") for w in (0, 1) for j in range(lane)]
    counted = exploded.groupBy(*keys, "size").agg(*sums)

    def bits(w: int) -> Column:
        count = f"shiftrightunsigned(l{w}[b % {lane}], {lane} * cast(b div {lane} as int)) & {(1 << lane) - 1}L"
        return F.expr(f"aggregate(sequence(0, 63), 0L, (acc, b) -> acc | shiftleft(cast(if(2 * ({count}) > size, 1, 0) as bigint), b))")

    lists = [F.array(*[f"s{w}_{j}" for j in range(lane)]).alias(f"l{w}") for w in (0, 1)]
    return counted.select(*keys, "size", *lists).select(*keys, "size", bits(0).alias("fp0"), bits(1).alias("fp1"))


def _blocks(rows: DataFrame) -> DataFrame:
    """A row for each of the 32 blocks of four bits."""
    nibble = lambda w, i: F.shiftrightunsigned(f"fp{w}", 4 * i).bitwiseAND(F.lit(15)).cast("int")
    return rows.select("*", F.posexplode(F.array(*[nibble(w, i) for w in (0, 1) for i in range(16)])).alias("block", "bits"))


def _empty_nibbles(x: Column) -> Column:
    full = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
    return F.bitwise_not(full).bitwiseAND(F.lit(0x1111111111111111))


def _bounded(small: DataFrame) -> DataFrame:
    """``small`` marked for broadcast if it has few rows; other sizes are left to a shuffle join."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """k1, k2, doc_id, item_id, start, n_words, distance, similarity: the best window of each document and item.

    A window has as many words as the item; a document with fewer is one window, compared
    with the items that its shingles name. It matches if the weighted Jaccard similarity
    of both shingle multisets reaches ``similarity``; items with fewer words than a shingle
    are one shingle. Windows that share too few shingles with an item to get there are not
    fingerprinted (a bound, not a guess). The others are hashed to 128 bits and looked up
    among the items of that size by 32 blocks, which finds every item within ``RADIUS``
    bits; pairs within it are verified exactly. Words are runs of letters and digits in
    lower case. Items without words, null texts and empty tables match nothing; a repeated
    item matches under each of its rows' ids, repeated documents are found once by (id,
    text). Ids may be of any type; k1 stands for the id (see ``id_key``), k2 is a hash of the
    text.
    """
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).dropDuplicates().withColumn("n", F.size("words")).filter("n > 0")
    items = materialise(items.withColumn("k", F.least("n", F.lit(shingle))).withColumn("u", F.xxhash64("item_id", "words")), "items")
    longest = {r["k"]: r["n"] for r in items.groupBy("k").agg(F.max("n").alias("n")).collect()}  # at most ``shingle`` rows
    sizes = sorted(longest)
    lane = 16 if max(longest.values(), default=0) < 1 << 15 else 32
    keyed = docs.select(id_key(docs).alias("k1"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k2"), "doc_id", words_of(F.col("text")).alias("words"))
    key = ["k1", "k2", "doc_id"]

    found = None
    for k in sizes:
        own = _exploded(items.filter(F.col("k") == k), ["u", "n", "k"], k).groupBy("u", "n", "k", "hash").agg(F.count("*").alias("in_item"))
        own = materialise(own, "shingles")
        spread = _exploded(keyed.withColumn("len", F.size("words")), [*key, "len"], k)
        # The benchmark is taken in blocks of bounded size, each against all documents.
        parts = -(-own.count() // BROADCAST_ROWS)
        for i in range(parts):
            block = own.filter(F.pmod("hash", F.lit(parts)) == i) if parts > 1 else own
            hit = spread.join(F.broadcast(block), "hash")
            found = hit if found is None else found.unionAll(hit)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"k1 long, k2 long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, start int, n_words int, distance int, similarity double")
    # Words of a window, and the shingles of the item and of the window.
    found = found.withColumn("m", F.least("len", "n"))
    theirs, ours = F.col("n") - F.col("k") + 1, F.col("m") - F.col("k") + 1
    hits = materialise(found.filter(ours >= F.lit(similarity) * theirs - 1e-9).distinct(), "hits")

    # A match shares at least t / (1 + t) of the shingles of both sides.
    shared = F.lit(similarity / (1 + similarity)) * (theirs + ours) - 1e-9
    enough = hits.groupBy("k1", "k2", "u", "n", "m", "k").agg(F.count("*").alias("c")).filter(F.col("c") >= shared).select("k1", "k2", "u")
    hits = materialise(hits.join(enough, ["k1", "k2", "u"]), "hits")

    first = F.greatest(F.col("pos") - (F.col("m") - F.col("k")), F.lit(0))
    last = F.least(F.col("pos"), F.col("len") - F.col("m"))
    starts = hits.filter(first <= last).select("k1", "k2", F.col("m").alias("n"), F.explode(F.sequence(first, last)).alias("start")).distinct()
    per_doc = materialise(starts.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "n")).alias("wanted")), "wanted")
    # First the suspect documents by their keys alone, then what is wanted from each.
    suspects = keyed.join(_bounded(per_doc.select("k1", "k2")), ["k1", "k2"], "left_semi").select("k1", "k2", "words")
    texts = suspects.join(per_doc, ["k1", "k2"]).select("k1", "k2", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), "wanted").dropDuplicates(["k1", "k2"])
    cut = F.transform("wanted", lambda x: F.struct(x["start"].alias("start"), F.slice("hashes", x["start"] + 1, x["n"]).alias("hashes")))
    windows = texts.select("k1", "k2", F.explode(cut).alias("w")).select("k1", "k2", "w.start", "w.hashes")
    prints = materialise(_fingerprints(windows, ["k1", "k2", "start"], lane), "prints")
    item_prints = _fingerprints(items.select("u", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")), ["u"], lane)
    # Whole documents are looked up among the sizes of the longer items that they hit.
    short = hits.filter("len < n").select("k1", "k2", F.col("m").alias("size"), "n").distinct()
    whole = prints.filter("start = 0").join(_bounded(short), ["k1", "k2", "size"]).select("k1", "k2", "start", F.col("n").alias("size"), "fp0", "fp1")
    sought = prints.select("k1", "k2", "start", "size", "fp0", "fp1").unionAll(whole)
    item_blocks = _blocks(materialise(item_prints, "prints")).withColumnsRenamed({"fp0": "i0", "fp1": "i1"})

    x0, x1 = F.col("fp0").bitwiseXOR(F.col("i0")), F.col("fp1").bitwiseXOR(F.col("i1"))
    distance = (F.bit_count(x0) + F.bit_count(x1)).cast("int")
    # A pair is taken at the first block that it shares, so it comes up once.
    below = lambda blocks: F.expr(f"shiftleft(1L, 4 * ({blocks})) - 1")
    earlier = F.when(F.col("block") < 16, _empty_nibbles(x0).bitwiseAND(below("block"))).otherwise(_empty_nibbles(x0).bitwiseOR(_empty_nibbles(x1).bitwiseAND(below("block - 16"))))
    near = _blocks(sought).join(item_blocks, ["size", "block", "bits"]).filter((earlier == 0) & (distance <= RADIUS)).select("k1", "k2", "start", "u", distance.alias("distance"))

    # Shingles of a window outside the item add nothing to the minimum, so the hits tell it exactly.
    inside = near.join(hits, ["k1", "k2", "u"]).filter("pos between start and start + m - k")
    by_hash = inside.groupBy(*key, "u", "start", "distance", "n", "m", "k", "hash", "in_item").agg(F.count("*").alias("c"))
    overlap = by_hash.groupBy(*key, "u", "start", "distance", "n", "m", "k").agg(F.sum(F.least("c", "in_item")).alias("low"))
    score = F.col("low") / (theirs + ours - F.col("low"))
    matched = overlap.withColumn("similarity", score).filter(F.col("similarity") >= similarity - 1e-12)
    best = matched.groupBy(*key, "u", F.col("m").alias("n_words")).agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"), "distance")).alias("b"))
    named = best.join(items.select("u", "item_id"), "u")
    return named.select(*key, "item_id", (-F.col("b.start")).cast("int").alias("start"), "n_words", "b.distance", "b.similarity")


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found."""
    bad = contaminated(docs, benchmark, similarity).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct()
    keyed = docs.withColumn("_k1", id_key(docs)).withColumn("_k2", F.xxhash64(F.coalesce("text", F.lit(""))))
    return keyed.join(bad, ["_k1", "_k2"], "left_anti").select(*docs.columns)
