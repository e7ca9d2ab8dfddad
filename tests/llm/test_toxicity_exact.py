"""Toxicity scores against plain dictionaries of n-grams."""

import inspect
import math
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from surgecast.llm import common, toxicity
from surgecast.llm.common import prepare

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def invented(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9)))


def case():
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(300):
        words = [invented(rng) for _ in range(60)]
        if i % 3 == 0:
            words[rng.randrange(60)] = rng.choice(["grubwort", "snarkel"])
        docs.append((i, " ".join(words)))
        if i % 4:
            labels.append((i, int(i % 3 == 0)))
    return [*docs, (900, None), (901, ""), (902, "q" * 3000), (None, "no id here"), docs[0]], labels


def plain_scores(docs, labels):
    truth = {i: t for i, t in labels if fold(i)}
    counts = defaultdict(lambda: [0, 0, 0])
    for i, t in docs:
        c = 2 if i not in truth or fold(i) == 1 else 1 - truth[i]
        for w in (t or "").lower().split():
            counts[w][c] += 1

    def grams(w):
        s = "\x02" * 4 + w + "\x03"
        return [s[k - 4 : k + 1] for k in range(4, len(s))]

    types = defaultdict(lambda: [0, 0, 0])
    for w, c in counts.items():
        for g in grams(w):
            types[g] = [a + b for a, b in zip(types[g], c)]
    cont = Counter(g[1:] for g in types)
    tot, kinds, uni = Counter(), Counter(), Counter()
    for m, n in cont.items():
        tot[m[:-1]] += n
        kinds[m[:-1]] += 1
        uni[m[-1]] += 1
    n, k = [Counter(), Counter()], [Counter(), Counter()]
    for g, c in types.items():
        for j in (0, 1):
            n[j][g[:-1]] += c[j]
            k[j][g[:-1]] += c[j] > 0
    d = toxicity.DISCOUNT

    def ratio(g):
        ctx, m = g[:-1], g[1:]
        if not n[0][ctx] + n[1][ctx]:
            return 0.0
        low = m[:-1]
        back = max(cont[m] - d, 0) / tot[low] + d * kinds[low] / tot[low] * (uni[m[-1]] + 1) / (len(cont) + len(uni))
        p = [max(types[g][j] - d, 0) / n[j][ctx] + d * k[j][ctx] / n[j][ctx] * back if n[j][ctx] else back for j in (0, 1)]
        return math.log(p[0] / p[1])

    value = {w: sum(map(ratio, grams(w))) for w in counts}

    def raw(t):
        ws = (t or "").lower().split()
        v = [value[w] for w in ws]
        return [sum(v) / (sum(map(len, ws)) + len(ws)), math.log1p(sum(x for x in v if x > toxicity.STRONG)), min(max(v), toxicity.CEILING)] if v else [0.0] * 3

    fit = [(raw(t), truth[i]) for i, t in docs if i in truth and fold(i) == 1]
    slopes, intercept = toxicity.fit_logistic(np.array([x for x, _ in fit]), np.array([y for _, y in fit]))
    return sorted((str(i), 1 / (1 + math.exp(-(float(np.dot(slopes, raw(t))) + intercept)))) for i, t in docs)


@pytest.mark.parametrize(("common", "common_words"), [(0, 0), (40, 100_000), (100_000, 300), (100_000, 100_000)])
def test_scores_equal_dictionaries(session, monkeypatch, common, common_words):
    """No n-gram takes the ratio of another, whether its word's value was sent out or joined."""
    monkeypatch.setattr(toxicity, "COMMON", common)
    monkeypatch.setattr(toxicity, "COMMON_WORDS", common_words)
    docs, labels = case()
    got = toxicity.score_documents(session.createDataFrame(docs, SCHEMA).repartition(3), session.createDataFrame(labels, "doc_id long, toxic int"))
    found = sorted((str(r["doc_id"]), r["score"]) for r in got.collect())
    want = plain_scores(docs, labels)
    assert [i for i, _ in found] == [i for i, _ in want]
    assert {a[0]: (a[1], b[1]) for a, b in zip(found, want) if abs(a[1] - b[1]) > 1e-6} == {}


def test_ids_of_text(session):
    """Ids may be strings; a null id is not held out."""
    docs, labels = case()
    named = [(None if i is None else f"d{i}", t) for i, t in docs]
    got = toxicity.score_documents(session.createDataFrame(named, "doc_id string, text string"), session.createDataFrame([(f"d{i}", t) for i, t in labels], "doc_id string, toxic int")).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in named)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    assert all(r["held_out"] == (zlib.crc32(r["doc_id"].encode()) % 5 == 0) for r in got if r["doc_id"])


def test_a_toxic_row_takes_no_other_row_along(session, tmp_path):
    """A clean row that shares a null or repeated id with a toxic one stays."""
    docs, labels = case()
    toxic, fine = "grubwort snarkel grubwort snarkel", docs[1][1]
    odd = [(None, toxic), (None, fine), (950, toxic), (950, fine), (951, None), (951, toxic)]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    rows = session.createDataFrame([(i, t, "en", "s", 1) for i, t in [*docs, *odd]], schema)
    session.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.toxicity_filter(session, rows, str(tmp_path))
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] in (None, 950, 951))
    assert kept.columns == rows.columns
    assert got == Counter([(None, "no id here"), (None, fine), (950, fine), (951, None)])


def test_calibration_reads_every_label(session):
    """The calibration is added up over all rows in tasks; nothing of a label is left out above a number of them."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (400, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.logistic(0, 1, 400) > 0.3).astype(int)
    rows = session.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], "mean double, strong double, most double, toxic int").repartition(5)
    slopes, intercept = toxicity._fit_rows(rows)
    want, level = toxicity.fit_logistic(x, y)
    np.testing.assert_allclose([*slopes, intercept], [*want, level], rtol=1e-6)
    assert toxicity._fit_rows(rows.limit(0)) is None
    assert "sample" not in inspect.signature(toxicity.score_documents).parameters


def test_sifted_rows_are_whole_and_keys_let_through(session, monkeypatch):
    """Every row is on one side, once, and those that meet a key on the first; a full sieve lets all through."""
    rows = session.range(5000).selectExpr("id as doc_id", "cast(id as string) as text").unionAll(session.createDataFrame([(None, "n"), (7, "again")], SCHEMA))
    for keys, bound in ((500, 900), (40_000, 5002)):
        monkeypatch.setattr(common, "SIEVE_MOST", common.SIEVE_PART)
        maybe, none = common.sifted(rows, F.xxhash64("doc_id"), session.range(0, 10 * keys, 10).withColumnRenamed("id", "key"), F.xxhash64("key"), keys)
        sides = [Counter((r["doc_id"], r["text"]) for r in side.collect()) for side in (maybe, none)]
        assert sides[0] + sides[1] == Counter((r["doc_id"], r["text"]) for r in rows.collect())
        assert all(i is None or i % 10 for i, _ in sides[1]) and sum(sides[0].values()) <= bound


def test_texts_without_a_label_are_not_shuffled(session, tmp_path, monkeypatch):
    """The class counts move the texts of labelled documents only, and the filter those of toxic ones."""
    moved = []
    monkeypatch.setattr(toxicity, "sifted", lambda rows, *a: moved.append((rows, made := common.sifted(rows, *a))) or made)
    docs, labels = case()
    frame = session.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars int")
    session.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    corpus_pipeline.toxicity_filter(session, frame, str(tmp_path)).collect()
    (rows, (maybe, _)), (all_, (bad, _)) = moved
    assert maybe.count() < 0.6 * rows.count() and bad.count() < 0.5 * all_.count()
