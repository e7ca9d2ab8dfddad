"""The pipeline against brute force, stage by stage."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from test_simple_ops import base_spans, check_packing, leaks, plain_fingerprint, roots

import __spark_entry__ as contract
from surgecast.llm import packing, queries, toxicity
from surgecast.llm.common import materialise, prepare, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage takes and gives."""
    docs, out = table(prepare(spark), sf_dir, "documents"), {}
    for name, fn in corpus_pipeline.STAGES:
        given = docs
        docs = materialise(fn(spark, given, sf_dir), name)
        out[name] = (given, docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "decontamination", "pii", "packing"]
    assert all(stages[n][1].columns == COLUMNS for n in list(stages)[:-1])


def test_toxic_documents_go(spark, sf_dir, stages):
    given, kept = stages["toxicity"]
    scored = toxicity.score_documents(given, table(spark, sf_dir, "labels")).collect()
    assert set(texts(kept)) == {r["doc_id"] for r in scored if r["predicted"] == 0}


def test_one_document_of_each_group_stays(stages):
    given, kept = (texts(d) for d in stages["simhash_dedup"])
    prints = {i: plain_fingerprint(t) for i, t in given.items()}
    values = sorted(set(prints.values()))
    group = roots(values, [(a, b) for a in values for b in values if a < b and bin(a ^ b).count("1") <= 4])
    lowest = {}
    for i, p in prints.items():
        lowest[group[p]] = min(i, lowest.get(group[p], i))
    assert kept == {i: given[i] for i in lowest.values()}


def test_benchmark_documents_go(spark, sf_dir, stages):
    given, kept = (texts(d) for d in stages["decontamination"])
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    bad = {i for i, _ in leaks(given.items(), items)}
    assert kept == {i: t for i, t in given.items() if i not in bad}


def test_personal_data_is_replaced(stages):
    given, kept = (texts(d) for d in stages["pii"])
    assert set(given) == set(kept)
    for i, t in given.items():
        if base_spans(t):
            assert kept[i] != t and not base_spans(kept[i])
    same = sum(kept[i] == t for i, t in given.items() if not base_spans(t))
    assert same >= 0.95 * sum(not base_spans(t) for t in given.values())
    assert all(r["n_chars"] == len(r["text"]) for r in stages["pii"][1].collect())


def test_every_token_is_packed_once(stages):
    given, pieces = stages["packing"]
    rows = pieces.collect()
    check_packing(rows, packing.MAX_LEN)
    exact = packing._exact("word_bpe_49k.json")
    want = {i: exact.encode(t, add_special_tokens=False).ids + [2] for i, t in texts(given).items()}
    got = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert got == want


def test_run_is_the_stages(spark, sf_dir, stages):
    key = lambda r: (r["doc_id"], r["start"], r["length"], bytes(r["ids"]))
    assert Counter(map(key, corpus_pipeline.run(spark, sf_dir).collect())) == Counter(map(key, stages["packing"][1].collect()))


def test_registered():
    names = contract.queries()
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(names) and "pipeline" not in contract.oracle_sql()


def test_odd_rows(spark, sf_dir, tmp_path):
    """Nulls, empties and repeated rows go through every stage."""
    base = table(spark, sf_dir, "documents").limit(40).collect()
    rows = [tuple(r) for r in base] + [(900, None, None, None, None), (901, "", "en", "s", 0), (None, "no id", "en", "s", 5), tuple(base[0]), (base[1]["doc_id"], "other text", "en", "s", 10)]
    docs = spark.createDataFrame(rows, table(spark, sf_dir, "documents").schema)
    for name, fn in corpus_pipeline.STAGES:
        docs = materialise(fn(spark, docs, sf_dir), name)
        assert docs.count() > 0
    empty = table(spark, sf_dir, "documents").limit(0)
    for name, fn in corpus_pipeline.STAGES:
        empty = materialise(fn(spark, empty, sf_dir), name)
        assert empty.count() == 0
