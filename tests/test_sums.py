import numpy as np
import pyarrow as pa

from surgecast.operators import forecasting


def sums(rows):
    names = ["s", "_g", "xx", "xy", "n"]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)


def test_totals_go_on_across_batches():
    """A group that a batch breaks off is added up with its rest; a NULL key is a key."""
    first = sums([(None, 0, [1.0], [2.0], 1), ("a", 0, [3.0], [4.0], 2)])
    second = sums([("a", 0, [5.0], [6.0], 3), ("a", 1, [7.0], [8.0], 4)])
    last = sums([("b", 1, [9.0], [1.0], 5)])
    found = {}
    for heads, totals in forecasting._totals(iter([first, second, last]), ["s", "_g"]):
        for head, (xx, xy, n) in zip(heads.to_pylist(), totals, strict=True):
            assert tuple(head.values()) not in found
            found[tuple(head.values())] = (xx[0], xy[0], n)
    assert found == {(None, 0): (1.0, 2.0, 1), ("a", 0): (8.0, 10.0, 5), ("a", 1): (7.0, 8.0, 4), ("b", 1): (9.0, 1.0, 5)}


def test_groups_are_whole():
    batches = [pa.RecordBatch.from_arrays([pa.array(k, pa.string())], names=["s"]) for k in (["a", "a"], ["a", "b", "c"], [], ["c", "d"])]
    made = [table.column("s").to_pylist()[i:j] for table, starts in forecasting._whole_groups(iter(batches), ["s"]) for i, j in zip(starts, [*starts[1:], table.num_rows])]
    assert made == [["a"] * 3, ["b"], ["c"] * 2, ["d"]]


def test_short_series_share_their_python_calls(spark):
    """No Python call of its own for each series, of which there may be very many."""
    rng = np.random.default_rng(2)
    rows = [(f"s{i}", 0, rng.normal(0, 1, 2).tolist(), float(i)) for i in range(6) for _ in range(5)]
    df = spark.createDataFrame(rows, "s string, _slot long, x array<double>, y double")
    made = forecasting.ridge_fit(df, ["s"], "x", "y", [1e-3, 1e-3])
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().toString()
    assert sorted((r["s"], r["n"]) for r in made.collect()) == [(f"s{i}", 5) for i in range(6)]
