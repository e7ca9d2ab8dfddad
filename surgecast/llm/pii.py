"""Personal data by pattern matches and by candidates that boosted trees select; built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_key, materialise

#: The base kinds. Loops are possessive and starts are anchored at the edge of a run (or at
#: the end of the match before), which finds the same leftmost matches in linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators; what they find is only a candidate.
CANDIDATES = {
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)*+",
    "number": r"\+?\(?[0-9](?:[\x20().-]{0,3}+[0-9])++",
    "token": r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{16,}+",
}
#: Cheap signs without which a pattern cannot match.
NEEDS = {"email": ("@",), "phone": ("+",), "address": ("@", "(at)", "[at]")}
CUES = r"(?i)(tel|phone|call|fax|mobile|mail|contact|card|visa|account|iban|ssn|address|host|ip|key|token|secret|password)\W*$"

#: Boosting: rounds, shrinkage, and the precision that selected candidates must reach on the calibration half.
ROUNDS, SHRINK, PRECISION = 24, 0.3, 0.95


def _found(kind: str, pattern: str) -> Column:
    """Matches of one kind in order: kind, index, length of the gap before, match, and what stands around it."""
    text, matches, gaps = F.col("text"), F.col(f"m_{kind}"), F.col(f"g_{kind}")
    n = F.size(matches)
    one = lambda i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(gaps[i]).alias("gap"), matches[i].alias("match"),
        F.right(gaps[i], F.lit(24)).alias("before"), F.left(gaps[i + 1], F.lit(2)).alias("after"),
    )
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one))


def _scan(docs: DataFrame) -> DataFrame:
    """key, doc_id and all matches of every row; texts stay behind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), id_key(docs).alias("k1"), F.xxhash64(text).alias("k2"))
    patterns = {**BASE, **CANDIDATES}
    t = F.col("text")
    none = F.array().cast("array<string>")

    def matches(kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        if kind not in NEEDS:
            return found
        sign = F.lit(False)
        for s in NEEDS[kind]:
            sign = sign | F.contains(t, F.lit(s))
        return F.when(sign, found).otherwise(none)

    rows = rows.select("*", *[matches(k, p).alias(f"m_{k}") for k, p in patterns.items()])
    # What can neither be valid nor selected is dropped before the positions are taken, where the whole kind is empty.
    rows = rows.select("*", *[F.when(F.size(f"m_{k}") > 0, F.split(t, p, -1)).alias(f"g_{k}") for k, p in patterns.items()])
    lists = [F.coalesce(_found(k, p), F.array().cast("array<struct<kind:string,i:int,gap:int,match:string,before:string,after:string>>")) for k, p in patterns.items()]
    return rows.select("k1", "k2", "doc_id", F.concat(*lists).alias("found"))


def _valid() -> Column:
    m, kind = F.col("match"), F.col("kind")
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    octet = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.try_to_number(F.regexp_replace(p, "^0+", ""), F.lit("999")), F.lit(0)) <= 255)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", F.forall(F.split(m, r"\."), octet))
        .when(kind == "card", n.between(16, 19) & F.expr("luhn_check(regexp_replace(match, '[^0-9]', ''))"))
        .when(kind == "phone", n.between(8, 15))
        .otherwise(False)
    )


def _features() -> dict[str, Column]:
    """Small whole numbers about generator, format and context; few of their combinations occur."""
    m = F.col("match")
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    letters = F.length(F.regexp_replace(m, "[^A-Za-z]", ""))
    groups = F.size(F.split(m, "[^A-Za-z0-9]+"))

    def step(c: Column, *edges: int) -> Column:
        out = F.lit(0)
        for e in edges:
            out = out + F.when(c >= e, 1).otherwise(0)
        return out

    edge = lambda c: F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike("^[A-Za-z0-9]"), 2).otherwise(3)
    kind = F.col("kind")
    return {
        "generator": F.when(kind == "address", 0).when(kind == "number", 1).otherwise(2),
        "digits": step(digits, 1, 7, 10, 13, 16, 20),
        "letters": step(letters, 1, 6),
        "groups": step(groups, 2, 3, 4, 6),
        "lead": F.when(m.startswith("+"), 2).when(m.startswith("("), 1).otherwise(0),
        "at": step(F.length(F.regexp_replace(m, "[^@]", "")), 1) + F.when(F.contains(m, F.lit("(at)")) | F.contains(m, F.lit("[at]")), 2).otherwise(0),
        "dots": step(F.length(F.regexp_replace(m, "[^.]", "")), 1, 3),
        "before": edge(F.right(F.col("before"), F.lit(1))),
        "after": edge(F.col("after")),
        "cue": F.when(F.col("before").rlike(CUES), 1).otherwise(0),
    }


def _rewritten(base: DataFrame) -> DataFrame:
    """Base matches in forms that only the generators find, where they stand: known personal data in candidates' clothes."""
    m, kind = F.col("match"), F.col("kind")
    digits = F.regexp_replace(m, "[^0-9]", "")
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    none = F.array().cast("array<string>")
    spelt = F.array(F.concat(local, F.lit("(at)"), domain), F.concat(local, F.lit(" [at] "), F.replace(domain, F.lit("."), F.lit(" [dot] "))))
    phone = F.array(F.substring(m, 2, 1 << 20), digits)
    card = F.array(F.trim(F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", "$1 - ")))
    forms = F.when(kind == "email", spelt).when(kind == "phone", phone).when(kind == "card", card).otherwise(none)
    generator = F.when(kind == "email", "address").otherwise("number")
    return base.select("k1", "k2", generator.alias("kind"), F.explode(forms).alias("match"), "before", "after")


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _best_split(cells, grads, names, inside):
    """(gain, feature, largest value of the left side) by gradient and curvature sums."""
    g_all = sum(grads[i][0] for i in inside)
    h_all = sum(grads[i][1] for i in inside)
    best = (1e-6, None, None)
    for f, name in enumerate(names):
        sums: dict[int, list[float]] = {}
        for i in inside:
            s = sums.setdefault(cells[i][0][f], [0.0, 0.0])
            s[0] += grads[i][0]
            s[1] += grads[i][1]
        g = h = 0.0
        for v in sorted(sums)[:-1]:
            g += sums[v][0]
            h += sums[v][1]
            gain = g * g / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all * g_all / (h_all + 1)
            if gain > best[0]:
                best = (gain, f, v)
    return best


def boost(cells: list[tuple[tuple[int, ...], float, float]], names: list[str], rounds: int = ROUNDS, shrink: float = SHRINK):
    """Gradient boosting of depth-two trees for the logistic loss over (feature values, rows, positives).

    A tree is (feature, value, left, right) with leaves as numbers. The cells are the
    combinations of feature values that occur, a number bounded by the features.
    """
    total, positive = sum(c[1] for c in cells), sum(c[2] for c in cells)
    base = math.log((positive + 0.5) / (total - positive + 0.5))
    score, trees = [base] * len(cells), []

    def leaf(inside, grads):
        return shrink * sum(grads[i][0] for i in inside) / (sum(grads[i][1] for i in inside) + 1)

    def grow(inside, grads, depth):
        _, f, v = _best_split(cells, grads, names, inside) if depth else (0, None, None)
        if f is None:
            return leaf(inside, grads)
        sides = [i for i in inside if cells[i][0][f] <= v], [i for i in inside if cells[i][0][f] > v]
        return (f, v, *(grow(s, grads, depth - 1) for s in sides))

    for _ in range(rounds):
        p = [_sigmoid(s) for s in score]
        grads = [(y - n * q, n * q * (1 - q)) for (_, n, y), q in zip(cells, p)]
        tree = grow(range(len(cells)), grads, 2)
        if not isinstance(tree, tuple):
            break
        trees.append(tree)
        score = [s + _tree_value(tree, c[0]) for s, c in zip(score, cells)]
    return base, trees


def _tree_value(tree, values) -> float:
    while isinstance(tree, tuple):
        f, v, left, right = tree
        tree = left if values[f] <= v else right
    return tree


def _tree_column(tree, names) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, v, left, right = tree
    return F.when(F.col(f"f_{names[f]}") <= v, _tree_column(left, names)).otherwise(_tree_column(right, names))


def threshold(scored: list[tuple[float, float, float]], precision: float = PRECISION) -> float:
    """Lowest score from which on the calibration rows (score, rows, positives) keep the precision; infinite if none does."""
    best, n, y = math.inf, 0.0, 0.0
    ordered = sorted(scored, reverse=True)
    for i, (s, rows, positives) in enumerate(ordered):
        n, y = n + rows, y + positives
        last_of_score = i + 1 == len(ordered) or ordered[i + 1][0] < s
        if last_of_score and (y + 0.5) / (n + 1) >= precision:
            best = s
    return best


def find_spans(docs: DataFrame, precision: float = PRECISION) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): key and doc_id of every row of ``docs`` (doc_id, text), and the spans of each key.

    The key is (k1, k2): the id and a hash of the text, so repeated rows share their spans.
    A span is (kind, start, end, is_base), in code points, end exclusive. Base spans are the
    matches of ``BASE`` that pass their check. Positive examples are candidates over a base
    span and base matches rewritten into forms that only the generators find; candidates
    elsewhere are negative. Half of the documents train the trees, the other half sets a
    threshold for each generator, in which candidates over a base span have no part where
    rewritten matches exist. Selected candidates without a base span under them are added
    with the kind of their generator. Ids may be of any type; null texts are empty; other
    columns are ignored.
    """
    scan = materialise(_scan(docs), "scan")
    rows = scan.select("k1", "k2", "doc_id")
    found = scan.filter(F.size("found") > 0).dropDuplicates(["k1", "k2"]).select("k1", "k2", F.explode("found").alias("x")).select("k1", "k2", "x.*")
    before = Window.partitionBy("k1", "k2", "kind").orderBy("i")
    start = F.sum(F.col("gap") + F.length("match")).over(before) - F.length("match")
    placed = found.withColumn("start", start).withColumn("end", F.col("start") + F.length("match")).withColumn("is_base", _valid())
    digits = F.length(F.regexp_replace("match", "[^0-9]", ""))
    wanted = F.col("is_base") | (F.col("kind") == "address") | ((F.col("kind") == "number") & (digits >= 7)) | ((F.col("kind") == "token") & F.col("match").rlike("[0-9]") & F.col("match").rlike("[A-Za-z]"))
    placed = materialise(placed.filter(wanted), "placed")

    by_start = Window.partitionBy("k1", "k2").orderBy("start", "kind")
    base_end = F.max(F.when(F.col("is_base"), F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    next_base = F.min(F.when(F.col("is_base"), F.col("start"))).over(by_start.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    hit = F.coalesce(base_end > F.col("start"), F.lit(False)) | F.coalesce(next_base < F.col("end"), F.lit(False))
    features = _features()
    names = list(features)
    featured = [c.alias(f"f_{n}") for n, c in features.items()]
    candidates = placed.withColumn("hit", hit).filter("not is_base").select("k1", "k2", "kind", "start", "end", "hit", *featured)
    candidates = materialise(candidates, "candidates")
    # Nothing is added over a base span, so where rewritten matches stand for the kind, candidates over one do not calibrate it.
    seen = candidates.select("k1", F.col("hit").alias("y"), (~F.col("hit") | (F.col("kind") == "token")).alias("judges"), *[f"f_{n}" for n in names])
    planted = _rewritten(placed.filter("is_base")).select("k1", F.lit(True).alias("y"), F.lit(True).alias("judges"), *featured)
    half, y, judges = F.pmod(F.xxhash64("k1"), F.lit(2)), F.col("y"), F.col("judges")
    cells = seen.unionAll(planted).groupBy(*[f"f_{n}" for n in names]).agg(
        F.count_if(half == 0).alias("n0"), F.count_if((half == 0) & y).alias("y0"), F.count_if((half == 1) & judges).alias("n1"), F.count_if((half == 1) & judges & y).alias("y1")
    ).collect()  # bounded by the combinations of feature values
    keyed = [(tuple(r[f"f_{n}"] for n in names), r) for r in sorted(cells, key=lambda r: tuple(r[f"f_{n}"] for n in names))]
    train = [(v, r["n0"], r["y0"]) for v, r in keyed if r["n0"]]
    spans = placed.filter("is_base").select("k1", "k2", "kind", "start", "end", "is_base")
    if train and any(c[2] for c in train):
        base, trees = boost(train, names)
        at = {}
        for g in range(len(CANDIDATES)):
            scored = [(base + sum(_tree_value(t, v) for t in trees), r["n1"], r["y1"]) for v, r in keyed if r["n1"] and v[0] == g]
            at[g] = threshold(scored, precision)
        limits = [(g, t) for g, t in at.items() if t < math.inf]
        if limits:
            score, chosen = F.lit(base), F.lit(False)
            for t in trees:
                score = score + _tree_column(t, names)
            for g, t in limits:
                chosen = chosen | ((F.col("f_generator") == g) & (score >= t - 1e-9))
            added = candidates.filter(~F.col("hit")).filter(chosen)
            spans = spans.unionAll(added.select("k1", "k2", "kind", "start", "end", F.lit(False)))
    return rows, materialise(spans, "spans")


KINDS = [*BASE, *CANDIDATES]


def span_lists(docs: DataFrame) -> DataFrame:
    """doc_id and spans, an array of (rank of the kind, start, end, kind, is_base) in that order, of every row."""
    rows, spans = find_spans(docs)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    listed = spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind", "is_base"))).alias("spans"))
    empty = F.array().cast(listed.schema["spans"].dataType)
    return rows.join(listed, ["k1", "k2"], "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, overlapping spans by the first one's; null texts stay."""
    _, spans = find_spans(docs)
    order = Window.partitionBy("k1", "k2").orderBy("start", F.desc("end"), "kind")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", F.when(F.col("start") < reached, 0).otherwise(1)).withColumn("g", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = new.groupBy("k1", "k2", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "kind")).alias("kind"))
    listed = merged.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("_cuts"))
    keyed = docs.withColumn("_k1", id_key(docs)).withColumn("_k2", F.xxhash64(F.coalesce("text", F.lit(""))))
    listed = listed.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "_cuts")
    joined = keyed.join(listed, ["_k1", "_k2"], "left")
    at = F.col("_cuts")
    piece = lambda i: F.concat(
        F.substring(F.col("text"), F.when(i == 0, 1).otherwise(F.get(at, i - 1)["end"] + 1), at[i]["start"] - F.when(i == 0, 0).otherwise(F.get(at, i - 1)["end"])),
        F.lit("["), F.upper(at[i]["kind"]), F.lit("]"),
    )
    tail = F.substring(F.col("text"), F.element_at(at, -1)["end"] + 1, F.length("text"))
    clean = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.size(at) - 1), piece), ""), tail)
    return joined.withColumn("text", F.when(at.isNull(), F.col("text")).otherwise(clean)).select(*docs.columns)
