"""Documents that are a benchmark item less some words, and items of very many words."""

import random

import pytest
from test_simple_ops import WORDS, Counter, leak_words, shingles

from surgecast.llm import decontaminate
from surgecast.llm.common import prepare


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def jaccard(a, b):
    have, want = Counter(shingles(leak_words(a))), Counter(shingles(leak_words(b)))
    return sum((have & want).values()) / sum((have | want).values())


def test_documents_shorter_than_the_item(session):
    rng = random.Random(4)
    items = [(k, " ".join(f"{rng.choice(WORDS)}{rng.randint(0, 40)}" for _ in range(n))) for k, n in enumerate([3, 6, 15, 40, 40, 60])]
    items += [(20, items[3][1] + " more words"), (21, items[5][1] + " one")]
    docs = []
    for k, q in items:
        w = q.split()
        for n, cut in enumerate((w[1:], w[:-2], w[1:-1], w[:-4], w[: len(w) * 8 // 10], w[: len(w) // 2], [*w[:9], *w[10:]])):
            docs.append((100 * k + n, " ".join(cut)))
    frame = session.createDataFrame(docs, "doc_id long, text string")
    bench = session.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(frame, bench).collect()
    short = [r for r in got if r["n_words"] < len(dict(items)[r["item_id"]].split())]
    want = {}
    for i, t in docs:
        for item, q in items:
            if len(t.split()) < len(q.split()) and jaccard(t, q) >= 0.8:
                want[i, item] = (round(jaccard(t, q), 9), 0, len(t.split()))
    assert len(want) > 15
    assert {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["start"], r["n_words"]) for r in short} == want
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})


def test_an_item_of_very_many_words(session):
    text = " ".join(["oak"] * 33_000)
    bench = session.createDataFrame([(1, text), (2, "ash birch cedar elm fir holly")], "item_id long, text string")
    frame = session.createDataFrame([(1, text), (2, "ash birch cedar elm fir holly"), (3, "pine")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame, bench).collect()} == {(1, 1), (2, 2)}
