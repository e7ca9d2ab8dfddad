"""Ids of any type, and the spans that the trees of ``pii`` add to the base ones."""

import random

import pytest

from surgecast.llm import decontaminate, pii, substring_dedup

PASSAGE = " ".join(f"word{i}" for i in range(30))


def with_ids(spark, kind, texts):
    """``texts`` under ids 1, 2, … of a type; the last one has none."""
    ids = [f"b-{i:03d}" if kind == "string" else i for i in range(1, len(texts))] + [None]
    return spark.createDataFrame(list(zip(ids, texts)), f"doc_id {kind}, text string"), ids


@pytest.mark.parametrize("kind", ["string", "int", "long", "double"])
def test_ids_of_any_type(spark, kind):
    if kind == "double":
        docs = spark.createDataFrame([(1.0, PASSAGE), (2.0, f"x {PASSAGE} y"), (None, f"z {PASSAGE}")], "doc_id double, text string")
        ids = [1.0, 2.0, None]
    else:
        docs, ids = with_ids(spark, kind, [PASSAGE, f"x {PASSAGE} y", f"z {PASSAGE}"])
    # The row without an id comes first, so it keeps the passage.
    kept = {r["doc_id"]: r["kept"] for r in substring_dedup.dedup_windows(docs).collect()}
    assert kept == {ids[0]: "", ids[1]: "x y", None: f"z {PASSAGE}"}

    items = spark.createDataFrame([("q", PASSAGE)], "item_id string, text string")
    found = decontaminate.contaminated(docs, items).collect()
    assert sorted((str(r["doc_id"]), r["similarity"]) for r in found) == sorted((str(i), 1.0) for i in ids)
    clean = docs.unionAll(docs.limit(0)).withColumn("k1", docs["doc_id"])
    assert decontaminate.clean(clean, items).count() == 0

    mail = docs.selectExpr("doc_id", "'write to me@example.org' AS text")
    spans = pii.span_lists(mail).collect()
    assert sorted(str(r["doc_id"]) for r in spans) == sorted(map(str, ids))
    assert all([(s["kind"], s["start"], s["end"]) for s in r["spans"]] == [("email", 9, 23)] for r in spans)
    assert {r["text"] for r in pii.redact(mail).collect()} == {"write to [EMAIL]"}


def test_string_ids_are_ordered_as_text(spark):
    docs = spark.createDataFrame([("b10", f"first? {PASSAGE}"), ("b9", f"last {PASSAGE}"), ("a", "short")], "doc_id string, text string")
    kept = {r["doc_id"]: r["kept"] for r in substring_dedup.dedup_windows(docs).collect()}
    assert kept == {"b10": f"first? {PASSAGE}", "b9": "last", "a": "short"}


@pytest.fixture(scope="module")
def mixed(spark):
    """Plain addresses and phones, a few written out, and a great many order numbers without any cue."""
    rng = random.Random(4)
    user = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    number = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    rows = []
    for i in range(400):
        text = f"order {number(9)} and order {number(9)} and order {number(9)} shipped"
        if i % 2 == 0:
            text += f" mail {user()}@site.org today"
        if i % 3 == 0:
            text += f" call +{number(11)} now"
        if i % 20 == 1:
            text += f" mail {user()}(at)site.org today"
        if i % 20 == 2:
            text += f" call {number(11)} now"
        rows.append((i, text))
    return {r["doc_id"]: (rows[r["doc_id"]][1], r["spans"]) for r in pii.span_lists(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_written_out_data_is_added(mixed):
    added = {i: [text[s["start"] : s["end"]] for s in spans if not s["is_base"]] for i, (text, spans) in mixed.items()}
    assert all(any("(at)" in a for a in added[i]) for i in range(1, 400, 20))
    assert all(any(len(a) == 11 and a.isdigit() for a in added[i]) for i in range(2, 400, 20))


def test_plain_numbers_are_left(mixed):
    for text, spans in mixed.values():
        for s in spans:
            if not s["is_base"]:
                assert "order" not in text[max(0, s["start"] - 6) : s["start"]]


def test_base_spans_stay(mixed):
    for i, (text, spans) in mixed.items():
        base = [s["kind"] for s in spans if s["is_base"]]
        assert base == ["email"] * (i % 2 == 0) + ["phone"] * (i % 3 == 0)


def test_without_base_matches_nothing_is_added(spark):
    rows = [(i, f"order 12345678{i} and a(at)b.org") for i in range(8)]
    out = pii.span_lists(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 8 and all(r["spans"] == [] for r in out)
