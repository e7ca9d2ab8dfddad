"""Quality by co-training: a view of the text and a view of the metadata teach each other."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Labelled rows that the two classifiers are fitted on, at most; unlabelled ones take part without a limit.
LABELLED = 30_000
ROUNDS = 3
#: Newton steps of one round over all unlabelled documents.
STEPS = 6
#: A pseudo-label must be this sure, and counts this much against a true label.
SURE, WEIGHT = 0.97, 0.3
#: Commonest values of each metadata field that have a column of their own, and columns that the others share by hash.
OWN, SHARED = 24, 24
FIELDS = ("lang", "source", "size")
LEAST = 4

TEXT = (
    "chars", "words", "word_length", "distinct_words", "top_word", "repeated_lines", "line_length", "short_lines",
    "letters", "upper", "digits", "spaces", "marks", "symbols", "pipes", "shouts", "bare_words", "long_words", "ends", "byte_entropy",
)

_KIND = np.full(256, 6, np.int64)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r", b".,;:'\"!?()-", b"#$%&*+/<=>@[\\]^_`{|}~")):
    _KIND[list(_chars)] = _i


def text_features(text: str) -> list[float]:
    """The numbers of ``TEXT``; all zero for a text without words."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return [0.0] * len(TEXT)
    bytes_of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    by_kind = np.bincount(_KIND, bytes_of, 7)
    n, w = len(raw), len(words)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, w)
    share = bytes_of[bytes_of > 0] / n
    bare = sum(c for x, c in counts.items() if not any(b > 127 or 65 <= b <= 90 or 97 <= b <= 122 for b in x))
    return [
        np.log1p(n), np.log1p(w), lengths.mean(), len(counts) / w, max(counts.values()) / w,
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(len(x) < 30 for x in lines) / len(lines),
        (by_kind[0] + by_kind[1] + by_kind[6]) / n, by_kind[1] / n, by_kind[2] / n, by_kind[3] / n, by_kind[4] / n, by_kind[5] / n,
        bytes_of[124] / n, bytes_of[33] / n, bare / w, (lengths > 20).mean(), sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines), float(-(share * np.log2(share)).sum()),
    ]


def _features(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.asarray(text_features(t or ""), np.float32) for t in batch.column("text").to_pylist()]
            flat = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.float32))
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(TEXT))
            keep = ("doc_id", "lang", "source", "n_chars")
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.ListArray.from_arrays(offsets, flat)], names=[*keep, "text_view"])

    return run


def _values(lang: list, source: list, n_chars: list) -> list[list[str]]:
    """The fields as texts; the stated length counts in doublings, and a null is a value of its own."""
    sizes = ["null" if c is None else str(int(c).bit_length() - 1 if c > 0 else 0) for c in n_chars]
    return [["null" if v is None else f"={v}" for v in lang], ["null" if v is None else f"={v}" for v in source], sizes]


def meta_features(lang: list, source: list, n_chars: list, own: dict[tuple[str, str], int]) -> np.ndarray:
    """A column for each value in ``own`` and ``SHARED`` hashed ones for all others."""
    out = np.zeros((len(lang), len(own) + SHARED))
    for name, values in zip(FIELDS, _values(lang, source, n_chars)):
        place = {v: own[name, v] if (name, v) in own else len(own) + zlib.crc32(f"{name}:{v}".encode()) % SHARED for v in set(values)}
        out[np.arange(len(values)), [place[v] for v in values]] += 1
    return out


def _common_values(feats: DataFrame) -> dict[tuple[str, str], int]:
    """Column numbers of the commonest values of each field over all documents."""
    size = F.when(F.col("n_chars").isNull(), "null").otherwise(F.when(F.col("n_chars") > 0, F.length(F.bin("n_chars")) - 1).otherwise(0).cast("string"))
    told = {c: F.when(F.col(c).isNull(), "null").otherwise(F.concat(F.lit("="), F.col(c))) for c in FIELDS[:2]} | {"size": size}
    own: dict[tuple[str, str], int] = {}
    for name in FIELDS:
        top = feats.groupBy(told[name].alias("v")).count().orderBy(F.desc("count"), "v").limit(OWN).collect()
        for r in top:
            own[name, r["v"]] = len(own)
    return own


class Logistic:
    """Penalised logistic regression on standardised columns."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, steps: int = 40):
        self.centre, scale = x.mean(axis=0), x.std(axis=0)
        self.scale = np.where(scale > 1e-9, scale, 1.0)
        z = self.standard(x)
        ridge = self.ridge = np.append(np.full(x.shape[1], penalty), 1e-6)
        self.w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            hess = (z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + np.diag(ridge)
            step = np.clip(np.linalg.solve(hess, z.T @ (weight * (p - y)) + ridge * self.w), -3, 3)
            self.w -= step
            if np.abs(step).max() < 1e-8:
                break

    def standard(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.column_stack([z, np.ones(len(x))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.w

    def moved(self, w: np.ndarray) -> Logistic:
        """The same columns with other weights."""
        other = copy(self)
        other.w = w
        return other


def _views(t: pa.Table | pa.RecordBatch, own: dict[tuple[str, str], int]) -> tuple[np.ndarray, np.ndarray]:
    """The text view and the metadata view of rows."""
    lists = t.column("text_view")
    flat = (lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, len(TEXT)).astype(float), meta_features(*(t.column(c).to_pylist() for c in ("lang", "source", "n_chars")), own)


def pseudo_sums(views: tuple[np.ndarray, np.ndarray], frozen: list[Logistic], now: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Gradient and Hessian for each view at the weights ``now``, over rows whose label the other view, ``frozen``, is sure of."""
    out = []
    for k in (0, 1):
        sure = 1 / (1 + np.exp(-np.clip(frozen[1 - k].logit(views[1 - k]), -500, 500)))
        at = (sure >= SURE) | (sure <= 1 - SURE)
        z, y = frozen[k].standard(views[k][at]), (sure[at] > 0.5).astype(float)
        p = 1 / (1 + np.exp(-np.clip(z @ now[k], -30, 30)))
        out.append((WEIGHT * z.T @ (p - y), WEIGHT * (z * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ z))
    return out


def _gathered(free: DataFrame, own: dict, frozen: list[Logistic], now: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """``pseudo_sums`` over all rows of ``free``: added up in tasks, then by cell, so the driver gets one gradient and Hessian a view."""
    dims = [len(w) for w in now]
    starts = np.cumsum([0, *[d * d + d for d in dims]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(starts[-1])
        for batch in batches:
            if batch.num_rows:
                total += np.concatenate([x.ravel() for pair in pseudo_sums(_views(batch, own), frozen, now) for x in pair])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "value"])

    cells = free.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros(starts[-1])
    total[cells.column("cell").to_numpy()] = cells.column("value").to_numpy()
    return [(total[a : a + d], total[a + d : a + d + d * d].reshape(d, d)) for a, d in zip(starts.tolist(), dims)]


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, sums, rounds: int = ROUNDS) -> list[Logistic]:
    """One classifier for each view; in each round the sure pseudo-labels of one join the other's examples.

    ``sums(frozen, now)`` gives each view's gradient and Hessian over the unlabelled rows.
    Columns stay standardised as the labelled rows have them, so rounds differ in weights alone.
    """
    models = [Logistic(v, y, np.ones(len(y))) for v in views]
    for _ in range(rounds):
        frozen, now = models, [m.w for m in models]
        for _ in range(STEPS):
            steps = []
            for m, v, w, (gradient, hessian) in zip(frozen, views, now, sums(frozen, now)):
                z = m.standard(v)
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                left = (z * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ z + hessian + np.diag(m.ridge)
                steps.append(np.clip(np.linalg.solve(left, z.T @ (p - y) + gradient + m.ridge * w), -3, 3))
            now = [w - s for w, s in zip(now, steps)]
            if max(np.abs(s).max() for s in steps) < 1e-6:
                break
        models = [m.moved(w) for m, w in zip(frozen, now)]
    return models


def score_documents(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """doc_id, text_score, meta_score, score, keep for every row of ``docs`` (doc_id, text, lang, source, n_chars).

    ``labels`` (doc_id, quality) is read where crc32 of the id modulo 5 is not 0; at most
    ``labelled`` rows of it, those with the smallest hashes, reach the driver, as numbers.
    Remainder 1 calibrates each view and their sum; the others train, and all documents
    without a label exchange pseudo-labels, of which the driver sees sums. Several labels of one document count as good if one says so; null
    labels and ids count for nothing. With too few of a class all scores are the base rate.
    Null or empty texts have zero features, null metadata is a value of its own.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    feats = materialise(rows.mapInArrow(_features(kind), f"doc_id {kind}, lang string, source string, n_chars long, text_view array<float>"), "features")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    joined = feats.filter("doc_id is not null").join(known, "doc_id", "left").withColumn("fold", fold)
    some = joined.filter("quality is not null and fold <> 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).toArrow()
    free = joined.filter("quality is null").select("text_view", "lang", "source", "n_chars")
    own = _common_values(feats)

    y, f = some.column("quality").to_numpy().astype(float), some.column("fold").to_numpy()
    if min([int(((y == c) & on).sum()) for c in (0, 1) for on in (f == 1, f > 1)]) < LEAST:
        base = float(y.mean()) if len(y) else 0.5
        flat = feats.select("doc_id", *[F.lit(base).alias(c) for c in ("text_score", "meta_score", "score")])
        return flat.withColumn("keep", F.col("score") >= 0.5)
    text, meta = _views(some, own)
    free = materialise(free, "unlabelled")
    models = co_train((text[f > 1], meta[f > 1]), y[f > 1], lambda frozen, now: _gathered(free, own, frozen, now))
    logits = [m.logit(v[f == 1])[:, None] for m, v in zip(models, (text, meta))]
    weight = np.ones(int((f == 1).sum()))
    calibrated = [Logistic(x, y[f == 1], weight, 0.1) for x in (*logits, np.hstack(logits))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (m.logit(v)[:, None] for m, v in zip(models, _views(batch, own)))
            out = [1 / (1 + np.exp(-np.clip(c.logit(x), -500, 500))) for c, x in zip(calibrated, (a, b, np.hstack([a, b])))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x) for x in out]], names=["doc_id", "text_score", "meta_score", "score"])

    return feats.mapInArrow(score, f"doc_id {kind}, text_score double, meta_score double, score double").withColumn("keep", F.col("score") >= 0.5)
