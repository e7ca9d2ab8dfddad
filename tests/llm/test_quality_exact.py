"""Co-training against the same rounds over one array in one process."""

import random
import zlib

import numpy as np
import pytest

from surgecast.llm import quality
from surgecast.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def case():
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(900):
        good = rng.random() < 0.5
        words = [rng.choice(["elm", "oak", "Fir.", "yew", "ash,"] if good else ["BUY!!", "now$$", "|", "elm"]) for _ in range(rng.randint(3, 40))]
        source = rng.choice(["books", "wiki", f"rare-{i % 200}"] if good else ["spam", "ads", f"rare-{i % 200}"])
        docs.append((i, " ".join(words), rng.choice(["en", "de", None]), source, rng.choice([None, 0, i])))
        if i < 160:
            labels.append((i, int(good)))
    return [*docs, (None, None, None, None, None), (950, "", "en", "books", 5)], labels


def plain_scores(docs, labels):
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    truth = {i: q for i, q in labels if fold(i)}
    values = quality._values(*([d[k] for d in docs] for k in (2, 3, 4)))
    own = {}
    for name, vs in zip(quality.FIELDS, values):
        for v in sorted(set(vs), key=lambda v: (-vs.count(v), v))[: quality.OWN]:
            own[name, v] = len(own)
    text = np.array([np.asarray(quality.text_features(d[1] or ""), np.float32) for d in docs], float)
    meta = quality.meta_features(*([d[k] for d in docs] for k in (2, 3, 4)), own)
    known = dict(labels)
    train = [k for k, d in enumerate(docs) if d[0] in truth and fold(d[0]) > 1]
    fit = [k for k, d in enumerate(docs) if d[0] in truth and fold(d[0]) == 1]
    free = [k for k, d in enumerate(docs) if d[0] is not None and d[0] not in known]
    y = lambda at: np.array([truth[docs[k][0]] for k in at], float)
    models = quality.co_train((text[train], meta[train]), y(train), lambda frozen, now: quality.pseudo_sums((text[free], meta[free]), frozen, now))
    logits = [m.logit(v)[:, None] for m, v in zip(models, (text, meta))]
    both = np.hstack(logits)
    out = [quality.Logistic(x[fit], y(fit), np.ones(len(fit)), 0.1).logit(x) for x in (*logits, both)]
    return {str(d[0]): [1 / (1 + np.exp(-o[k])) for o in out] for k, d in enumerate(docs)}, len(free)


def test_all_unlabelled_documents_take_part(session):
    docs, labels = case()
    got = quality.score_documents(session.createDataFrame(docs, SCHEMA).repartition(5), session.createDataFrame(labels, "doc_id long, quality int")).collect()
    want, free = plain_scores(docs, labels)
    assert len(got) == len(docs) and free > 700
    for r in got:
        assert [r["text_score"], r["meta_score"], r["score"]] == pytest.approx(want[str(r["doc_id"])], abs=1e-6)


def test_values_beyond_the_common_ones_share_columns():
    own = {("lang", "=en"): 0, ("source", "=a"): 1, ("size", "3"): 2}
    x = quality.meta_features(["en", None], ["a", "zz"], [8, None], own)
    assert x[0].tolist() == [1.0, 1.0, 1.0] + [0.0] * quality.SHARED
    assert x[1, :3].tolist() == [0, 0, 0] and x[1].sum() == 3
