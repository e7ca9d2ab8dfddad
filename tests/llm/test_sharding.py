"""Shuffled shards: laws, whole results, independence of files and partitions."""

from collections import Counter

import numpy as np
import pytest

from surgecast.llm import queries, sharding
from surgecast.llm.common import prepare, scratch_dir, table

SCHEMA = "doc_id long, text string, shard string, `_key` int, extra array<int>"


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def placed(frame):
    return sorted((r["shard"], r["slot"], r["doc_id"], r["text"]) for r in frame.collect())


def check_law(got, shards, n):
    counts = Counter(s for s, *_ in got)
    assert len(got) == n and all(0 <= s < shards for s in counts)
    sizes = [counts[s] for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert [slot for t, slot, *_ in got if t == s] == list(range(sizes[s]))


def test_query_keeps_every_document(session, sf_dir):
    docs = table(session, sf_dir, "documents").toPandas()
    got = queries.op13_sharding(session, sf_dir).toPandas()
    check_law(sorted(zip(got.shard, got.slot, got.doc_id)), 40, len(docs))
    import zlib

    want = sorted((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in zip(docs.doc_id, docs.text))
    assert sorted(zip(got.doc_id, got["size"], got.text_crc32)) == want
    assert set(got.law) == {"rows"} and got.grown_shard.isna().all()


def odd_rows():
    rows = [(i, f"text {i % 7}", "mine", i, [i]) for i in range(200)]
    rows += [(None, None, "mine", 1, None)] * 150 + [(5, "", "mine", 2, [])] * 3 + [(6, "x" * 5_000, "mine", 3, [])]
    return rows


@pytest.mark.parametrize("bucket_bytes", [1 << 10, 1 << 20])
def test_repeated_rows_and_odd_columns(session, bucket_bytes):
    """A third of all rows are one row; shards stay equal, and nothing is lost, whatever the partitions."""
    rows = odd_rows()
    frame = session.createDataFrame(rows, SCHEMA)
    first = sharding.shuffled_shards(frame.repartition(3), shards=7, bucket_bytes=bucket_bytes)
    assert first.columns == ["doc_id", "text", "_key", "extra", "shard", "slot"]
    got = placed(first)
    check_law(got, 7, len(rows))
    assert Counter((d, t) for _, _, d, t in got) == Counter((r[0], r[1]) for r in rows)
    assert placed(sharding.shuffled_shards(frame.repartition(5, "text"), shards=7, bucket_bytes=bucket_bytes)) == got
    assert placed(sharding.shuffled_shards(frame, shards=7, seed=9, bucket_bytes=bucket_bytes)) != got
    # The repeated row is spread: no shard holds twice its part.
    per = Counter(s for s, _, d, t in got if d is None)
    assert len(per) == 7 and max(per.values()) < 2 * 150 / 7 + 8


def test_every_order_is_as_likely(session):
    counts = Counter(tuple(sharding._fisher_yates(4, [3, k]).tolist()) for k in range(4_800))
    assert len(counts) == 24
    assert sum((c - 200) ** 2 / 200 for c in counts.values()) < 50  # chi square with 23 degrees of freedom
    frame = session.createDataFrame([(i, f"t{i}", "", 0, []) for i in range(2_000)], SCHEMA)
    got = placed(sharding.shuffled_shards(frame, shards=4, bucket_bytes=4 << 10))
    quarter = Counter((s, d // 500) for s, _, d, _ in got)
    assert sum((quarter[s, q] - 125) ** 2 / 125 for s in range(4) for q in range(4)) < 30
    assert abs(np.corrcoef([d for *_, d, _ in got], range(len(got)))[0, 1]) < 0.08


def test_files_are_in_slot_order(session):
    frame = session.createDataFrame(odd_rows(), SCHEMA)
    folder = scratch_dir(session, "written")
    back = sharding.write_shards(frame, folder, shards=5, bucket_bytes=1 << 10)
    check_law(placed(back), 5, len(odd_rows()))
    one = [r["slot"] for r in session.read.parquet(f"{folder}/shard=2").collect()]
    assert sorted(one) == list(range(len(one)))


def test_no_rows_and_few_rows(session):
    assert sharding.shuffled_shards(session.createDataFrame([], SCHEMA)).collect() == []
    got = placed(sharding.shuffled_shards(session.createDataFrame([(1, None, "", 0, None), (2, "b", "", 0, None)], SCHEMA), shards=40))
    assert len(got) == 2 and all(slot == 0 for _, slot, *_ in got)
