"""Workers give memory back between the tasks of the pipeline's Python steps, and reads keep no buffers beside the heap."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

from surgecast.llm import common, packing, simhash, toxicity

REPO = str(Path(__file__).resolve().parents[2])

#: Counts the words of 40 MB of texts twice, and prints the MB that the process then holds beyond its start.
COUNTED = """
import re
import pyarrow as pa
from surgecast.llm import common, toxicity

def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def batches():
    for k in range(40):
        texts = [" ".join(f"word{k}x{i}y{j}" for j in range(90)) for i in range(1000)]
        yield pa.record_batch([pa.array([2] * 1000), pa.array(texts)], names=["class", "text"])

before = held()
for _ in range(2):
    for _ in common.lean(toxicity._count)(batches()):
        pass
print(held() - before)
"""


@pytest.fixture
def mapped(spark, monkeypatch):
    """The functions that are handed to mapInArrow."""
    got, kind = [], type(spark.range(0))
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **b: got.append(f) or plain(self, f, *a, **b))
    return got


def _released(monkeypatch, run, batch):
    """How often ``run`` gives memory back over one batch."""
    calls = []

    class Pool:
        def release_unused(self):
            calls.append(1)

    with monkeypatch.context() as m:
        m.setattr(pa, "default_memory_pool", Pool)
        list(run(iter([batch])))
    return len(calls)


def test_steps_give_memory_back(spark, mapped, monkeypatch):
    docs = spark.createDataFrame([(i, f"text number {i} of a few words") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    common.prepare(spark)
    simhash.near_duplicate_groups(docs)
    packing.pack_documents(docs)
    toxicity.clean(docs, labels).count()
    assert len(mapped) >= 9
    for f in mapped:
        empty = pa.record_batch([pa.array([], pa.int64())], names=["none"])
        assert _released(monkeypatch, lambda _, f=f: f(iter([])), empty) == 1, f


def test_counted_words_are_not_kept():
    out = subprocess.run([sys.executable, "-c", COUNTED], cwd=REPO, capture_output=True, text=True, check=True, timeout=300).stdout
    assert float(out) < 120


def test_reads_keep_no_buffers(spark):
    common.prepare(spark)
    # What readers are given.
    assert spark._jsparkSession.sessionState().newHadoopConf().get("parquet.hadoop.vectored.io.enabled") == "false"
