"""Toxicity by class-conditional Kneser-Ney character models that share their backoff counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, sifted

#: Characters of one n-gram, word edges included.
ORDER = 5
DISCOUNT = 0.75
#: What the calibration sees of a text: its log-likelihood ratio for each character, and, as a
#: few toxic words vanish in the mean of a long text, that of the words which alone are
#: e**STRONG times likelier in toxic texts, on a log scale, and that of the likeliest word.
RAW = ("mean", "strong", "most")
STRONG, CEILING = 4.0, 12.0
#: A class needs this many labelled documents, or the score is the base rate.
LEAST = 3
#: Words whose counts a worker keeps, and words whose values all workers hold, the commonest; the others' are joined.
KNOWN = 600_000
COMMON_WORDS = 1 << 20
#: N-grams whose ratios all workers hold, the commonest; those of the others are joined.
COMMON = 1 << 20

CLASSES = ("toxic", "plain", "rest")


def _split(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The lower-case words of all texts, encoded by the distinct ones, and the row of each."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(texts.fill_null("")))
    words, row = split.flatten(), np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    # White space at an end leaves an empty word.
    real = pc.not_equal(words, "")
    return words.filter(real).dictionary_encode(), row[real.to_numpy(zero_copy_only=False)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each word by class, added up within a task and given out when many are held."""
    held: list[pa.Table] = []

    def added() -> pa.Table:
        sums = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([(c, "sum") for c in CLASSES])
        return sums.select(["word", *[f"{c}_sum" for c in CLASSES]]).rename_columns(["word", *CLASSES])

    for batch in batches:
        words, row = _split(batch.column("text"))
        k = len(words.dictionary)
        at = words.indices.to_numpy().astype(np.int64) * 3 + batch.column("class").to_numpy()[row]
        counts = np.bincount(at, minlength=3 * k).reshape(k, 3)
        held.append(pa.table([words.dictionary, *[pa.array(np.ascontiguousarray(c)) for c in counts.T]], names=["word", *CLASSES]))
        if sum(t.num_rows for t in held) > KNOWN:
            held = [added()]
            if held[0].num_rows > KNOWN // 2:
                yield from held.pop().to_batches(max_chunksize=50_000)
    if held:
        yield from added().to_batches(max_chunksize=50_000)


_A, _B = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)


def _grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Word and code of each character or end mark, and for n = order-2 to order the hash of the n characters up to it.

    A word is padded in front, so an n-gram never reaches into another word.
    """
    text = "".join(["\x02" * (order - 1) + w + "\x03" for w in words])
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + order
    start = np.cumsum(sizes) - sizes
    h, hashes = np.zeros(len(code), np.uint64), []
    for n in range(1, order + 1):
        h = h + np.roll((code + _B) * np.array([pow(_A, n, 1 << 64)], np.uint64), n - 1)
        if n >= order - 2:
            mixed = (h ^ (h >> np.uint64(31))) * _B
            hashes.append(mixed ^ (mixed >> np.uint64(29)))
    real = np.ones(len(code), bool)
    for k in range(order - 1):
        real[start + k] = False
    which = np.repeat(np.arange(len(words)), sizes)
    # The context of a character is what ends before it.
    low, mid, top = hashes[0], hashes[1], hashes[2]
    return which[real], code[real], [x[real] for x in (np.roll(low, 1), mid, np.roll(mid, 1), top)]


def _types(order: int):
    """Class counts of the n-grams of distinct words, with the hashes of their contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            which, code, (low_ctx, mid, ctx, top) = _grams(batch.column("word").to_pylist(), order)
            _, first, at = np.unique(top, return_index=True, return_inverse=True)
            cols = [pa.array(x[first].view(np.int64)) for x in (top, ctx, mid, low_ctx)] + [pa.array(code[first].astype(np.int64))]
            cols += [pa.array(np.bincount(at, batch.column(c).to_numpy()[which].astype(float), len(first)).astype(np.int64)) for c in CLASSES]
            yield pa.RecordBatch.from_arrays(cols, names=["gram", "ctx", "mid", "low_ctx", "code", *CLASSES])

    return run


def log_ratios(types: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """(gram, total, ratio) of every n-gram; the ratio is zero where no class has seen the context.

    Each class discounts its own counts and backs off to one distribution for both: the
    continuation counts of the next shorter n-grams over all documents, which back off to
    those of single characters. Where no class has seen an n-gram, the shared factor
    cancels and the ratio is that of the back-off weights.
    """
    d = F.lit(discount)
    mids = types.groupBy("mid").agg(F.count("*").alias("cont"), F.first("low_ctx").alias("low_ctx"), F.first("code").alias("code"))
    mids = materialise(mids, "mids")
    lows = mids.groupBy("low_ctx").agg(F.sum("cont").alias("tot"), F.count("*").alias("kinds"))
    codes = mids.groupBy("code").agg(F.count("*").alias("uni"))
    whole = mids.agg(F.count("*").alias("all"), F.countDistinct("code").alias("v"))
    single = codes.join(whole).select("code", ((F.col("uni") + 1) / (F.col("all") + F.col("v"))).alias("p1"))
    shared = mids.join(lows, "low_ctx").join(single, "code").select("mid", (F.greatest(F.col("cont") - d, F.lit(0.0)) / F.col("tot") + d * F.col("kinds") / F.col("tot") * F.col("p1")).alias("back"))

    ctx = types.groupBy("ctx").agg(*[F.sum(c).alias(f"{c}_n") for c in CLASSES[:2]], *[F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in CLASSES[:2]])
    ctx = materialise(ctx.filter("toxic_n + plain_n > 0"), "contexts")

    def p(c: str):
        weight = F.when(F.col(f"{c}_n") > 0, d * F.col(f"{c}_kinds") / F.col(f"{c}_n")).otherwise(1.0)
        own = F.when(F.col(f"{c}_n") > 0, F.greatest(F.col(c) - d, F.lit(0.0)) / F.col(f"{c}_n")).otherwise(0.0)
        return own + weight * F.col("back")

    ratio = F.coalesce(F.log(p("toxic") / p("plain")), F.lit(0.0)).alias("ratio")
    return types.join(shared, "mid").join(ctx, "ctx", "left").select("gram", (F.col("toxic") + F.col("plain") + F.col("rest")).alias("total"), ratio)


def _commonest(rows: DataFrame, key: str, value: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and their values, at most ``most`` of them: those whose ``total`` is above a count, in steps of a quarter octave."""
    size = F.floor(4 * F.log2("total"))
    room, least = most, None
    for r in sorted(rows.groupBy(size.alias("size")).count().collect(), key=lambda r: -r["size"]):  # one row per step
        room -= r["count"]
        if room < 0:
            break
        least = r["size"]
    got = rows.filter(size >= least if least is not None else F.lit(False)).select(key, value).toArrow()
    keys, values = got.column(key).to_numpy(), got.column(value).to_numpy()
    by = np.argsort(keys)
    return keys[by], values[by]


def _look_up(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Values of hashed n-grams or words, NaN where the table does not hold them."""
    keys, values = table
    if not len(keys):
        return np.full(len(hashes), np.nan)
    hashes = hashes.view(np.int64)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, values[at], np.nan)


def _valued(common, order: int):
    """The log-likelihood ratio of each distinct word, as far as the table of the workers tells.

    A word whose n-grams are all there has one row, without ``gram``; another has a row for
    each n-gram that is lacking, and ``part``, the ratios of the others, in the first of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            which, _, (_, _, _, top) = _grams(batch.column("word").to_pylist(), order)
            r = _look_up(common.value, top)
            lacking = np.isnan(r)
            part = np.bincount(which[~lacking], r[~lacking], batch.num_rows).astype(float)  # of no weights: whole numbers
            open_, grams = which[lacking], top[lacking].view(np.int64)
            first = np.concatenate([[True], open_[1:] != open_[:-1]])[: len(open_)]
            whole = np.setdiff1d(np.arange(batch.num_rows), open_)
            at = np.concatenate([whole, open_])
            gram = pa.array(np.concatenate([np.zeros(len(whole), np.int64), grams]), mask=np.arange(len(at)) < len(whole))
            parts = np.concatenate([part[whole], np.where(first, part[open_], 0.0)])
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column("w").take(rows), batch.column("total").take(rows), gram, pa.array(parts)], names=["w", "total", "gram", "part"])

    return run


def _word_values(words: DataFrame, ratios: DataFrame, order: int) -> DataFrame:
    """w (the hash of a word), total, value: the sum of the ratios of each distinct word's n-grams.

    The commonest n-grams are sent to all workers, a table of bounded size; the others are
    joined, so the model may grow with the input.
    """
    common = words.sparkSession.sparkContext.broadcast(_commonest(ratios, "gram", "ratio", COMMON))
    total = F.col("toxic") + F.col("plain") + F.col("rest")
    told = materialise(words.select(F.xxhash64("word").alias("w"), "word", total.alias("total")).mapInArrow(lean(_valued(common, order)), "w long, total long, gram long, part double"), "told")
    common.unpersist()
    lacking = told.filter("gram is not null").join(ratios.select("gram", "ratio"), "gram")
    summed = lacking.groupBy("w").agg(F.max("total").alias("total"), F.sum(F.col("part") + F.col("ratio")).alias("value"))
    return materialise(told.filter("gram is null").select("w", "total", F.col("part").alias("value")).unionAll(summed), "values")


def _partial(common):
    """What each row's words tell by the values that the workers hold, and the hashes and counts of its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            n = batch.num_rows
            words, row = _split(batch.column("text"))
            # What Spark's xxhash64 gives.
            hashes = np.array([digest(w.encode(), 42) for w in words.dictionary.to_pylist()], np.uint64).view(np.int64)
            at = words.indices.to_numpy().astype(np.int64)
            chars = pc.utf8_length(words.dictionary).to_numpy() + 1
            value = _look_up(common.value, hashes)[at]
            other = np.isnan(value)
            v, of = value[~other], row[~other]
            top = np.full(n, -np.inf)
            np.maximum.at(top, of, v)
            rare, count = np.unique(row[other] * max(1, len(hashes)) + at[other], return_counts=True)
            rare_row, rare_word = np.divmod(rare, max(1, len(hashes)))
            stops = np.concatenate([[0], np.cumsum(np.bincount(rare_row, minlength=n))])
            pairs = pa.StructArray.from_arrays([pa.array(hashes[rare_word]), pa.array(count.astype(np.int64))], names=["w", "n"])
            cols = [
                pa.array(np.bincount(row, chars[at], n).astype(np.int64)), pa.array(np.bincount(of, v, n).astype(float)), pa.array(np.bincount(of, np.where(v > STRONG, v, 0.0), n).astype(float)),
                pa.array(top, mask=np.isneginf(top)), pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pairs),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("tag"), *cols], names=["row", "doc_id", "tag", "chars", "all", "high", "top", "rare"])

    return run


def _evidence(rows: DataFrame, values: DataFrame) -> DataFrame:
    """doc_id, tag and the columns of ``RAW`` for every row of ``rows`` (doc_id, tag, text).

    Each distinct word is valued once; the values of the commonest are sent to all workers,
    a table of bounded size, and the other words of a row meet theirs in a join.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    common = rows.sparkSession.sparkContext.broadcast(_commonest(values, "w", "value", COMMON_WORDS))
    types = f"row long, doc_id {kind}, tag long, chars long, all double, high double, top double, rare array<struct<w: long, n: long>>"
    part = materialise(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(lean(_partial(common)), types), "partial")
    common.unpersist()
    others = part.select("row", F.explode("rare").alias("r")).select("row", "r.w", "r.n").join(values.select("w", "value"), "w")
    value, high = F.col("value") * F.col("n"), F.when(F.col("value") > STRONG, F.col("value") * F.col("n"))
    added = others.groupBy("row").agg(F.sum(value).alias("_all"), F.sum(high).alias("_high"), F.max("value").alias("_top"))
    zero = F.lit(0.0)
    mean = F.when(F.col("chars") > 0, (F.col("all") + F.coalesce("_all", zero)) / F.col("chars")).otherwise(0.0)
    most = F.least(F.coalesce(F.greatest("top", "_top"), zero), F.lit(CEILING))
    return part.drop("rare").join(added, "row", "left").select("doc_id", "tag", mean.alias("mean"), F.log1p(F.col("high") + F.coalesce("_high", zero)).alias("strong"), most.alias("most"))


def _newton(sums, count: float, mean: np.ndarray, std: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """(weights, intercept) of a slightly penalised logistic regression.

    ``sums(centre, scale, w)`` gives the gradient and the Hessian over all rows, of standardised
    columns and a constant.
    """
    centre, scale = mean, np.where(std > 0, std, 1.0)
    penalty = np.append(np.full(len(centre), 1e-2), 1e-6)
    w = np.zeros(len(penalty))
    for _ in range(steps if count else 0):
        gradient, hess = sums(centre, scale, w)
        step = np.clip(np.linalg.solve(hess + np.diag(penalty), gradient + penalty * w), -3, 3)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[:-1] / scale
    return slopes, float(w[-1] - slopes @ centre)


def _gradient(x: np.ndarray, y: np.ndarray, centre: np.ndarray, scale: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
    return z.T @ (p - y), (z * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ z


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[np.ndarray, float]:
    """(weights, intercept) of a slightly penalised logistic regression of ``y`` on the columns of ``x``."""
    return _newton(lambda *at: _gradient(x, y, *at), len(x), x.mean(axis=0), x.std(axis=0), steps)


def _fit_rows(rows: DataFrame, steps: int = 60) -> tuple[np.ndarray, float] | None:
    """``fit_logistic`` over all ``rows`` (``RAW``, toxic): tasks add up, the driver takes the steps; None without rows."""
    stats = rows.agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.avg, F.stddev_pop) for c in RAW]).first()
    if not stats["n"]:
        return None
    size = len(RAW) + 1

    def sums(centre: np.ndarray, scale: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size + size * size)
            for batch in batches:
                x = np.column_stack([batch.column(c).to_numpy() for c in RAW])
                total += np.concatenate([part.ravel() for part in _gradient(x, batch.column("toxic").to_numpy(), centre, scale, w)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

        made = rows.mapInArrow(lean(run), "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
        got = np.array([r["v"] for r in sorted(made.collect(), key=lambda r: r["i"])])  # a gradient and a Hessian
        return got[:size], got[size:].reshape(size, size)

    means, stds = (np.array([stats[f"{f}_{c}"] for c in RAW], float) for f in ("avg", "stddev_pop"))
    return _newton(sums, stats["n"], means, stds, steps)


def score_documents(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; see ``_scored``."""
    return _scored(docs, labels, order).drop("tag")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, told apart by id and text hash."""
    bad = _scored(docs, labels).filter("predicted = 1").select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct()
    bad = materialise(bad, "toxic")
    maybe, fine = sifted(docs, _tag(), bad, F.col("_tag"), bad.count())
    return fine.unionAll(maybe.join(bad, maybe["doc_id"].eqNullSafe(bad["_id"]) & (_tag() == bad["_tag"]), "left_anti"))


def _tag():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _scored(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, tag (a hash of the text), held_out, score, predicted for every row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, toxic) is read only where crc32 of the id modulo 5 is not 0, but all
    of it there; remainder 1 calibrates and the others count n-grams by class. Backoff counts come from all documents. A document with
    several labels is toxic if one says so; null labels and ids count for nothing. Null or
    empty texts have zero evidence. With fewer than three
    documents of a class all scores are the base rate. Columns other than the named are
    ignored, and repeated rows keep one row each.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", _tag().alias("tag"), "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = labels.select(F.expr(f"try_cast(doc_id as {kind})").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", fold).filter("fold <> 0")
    known = materialise(known, "labelled")
    held_out = F.coalesce(fold == 0, F.lit(False)).alias("held_out")
    seen = {(r["toxic"], r["fitting"]): r["count"] for r in known.groupBy("toxic", (F.col("fold") == 1).alias("fitting")).count().collect()}
    positive, total = (sum(n for (c, _), n in seen.items() if c in which) for which in ([1], [0, 1]))
    base = positive / total if total else 0.0
    if min(seen.get((c, on), 0) for c in (0, 1) for on in (True, False)) < LEAST:
        flat = rows.select("doc_id", "tag", held_out, F.lit(base).alias("score"))
        return flat.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))

    counting = known.filter("fold > 1").select("doc_id", "toxic")
    # Only texts that may have a label meet the labels in a join.
    maybe, none = sifted(rows.filter("text is not null"), F.xxhash64("doc_id"), counting, F.xxhash64("doc_id"), sum(n for (_, fitting), n in seen.items() if not fitting))
    classed = maybe.join(counting, "doc_id", "left")
    classed = classed.select("text", F.when(F.col("toxic") == 1, 0).when(F.col("toxic") == 0, 1).otherwise(2).alias("class"))
    classed = classed.unionAll(none.select("text", F.lit(2).alias("class")))
    sums = [F.sum(c).alias(c) for c in CLASSES]
    words = materialise(classed.mapInArrow(lean(_count), "word string, toxic long, plain long, rest long").groupBy("word").agg(*sums), "words")
    grams = words.mapInArrow(lean(_types(order)), "gram long, ctx long, mid long, low_ctx long, code long, toxic long, plain long, rest long")
    same = [F.first(c).alias(c) for c in ("ctx", "mid", "low_ctx", "code")]
    types = materialise(grams.groupBy("gram").agg(*same, *sums), "types")
    ratios = materialise(log_ratios(types), "ratios")
    raw = materialise(_evidence(rows, _word_values(words, ratios, order)), "raw")

    fitted = materialise(raw.join(known.filter("fold = 1").select("doc_id", "toxic"), "doc_id").select(*RAW, "toxic"), "calibration")
    slopes, intercept = _fit_rows(fitted) or (np.ones(len(RAW)), 0.0)
    z = F.lit(intercept)
    for c, slope in zip(RAW, slopes.tolist()):
        z = z + F.lit(slope) * F.col(c)
    scored = raw.select("doc_id", "tag", held_out, (1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
