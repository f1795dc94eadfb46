import random

import pytest
from pyspark.sql import functions as F

from pulseloom.llm.collapse_runs import collapse_runs


def equal(a, b, tolerance):
    if a is None or b is None:
        return a is None and b is None
    return a == b or tolerance is not None and abs(a - b) <= tolerance


def brute(rows, tolerance=None, contiguous=True):
    by, out = {}, []
    for key, at, value in rows:
        if at is not None:
            by.setdefault(key, []).append((at, (value is not None, value if value is not None else 0), value))
    for key, events in by.items():
        run = None
        for at, _, value in sorted(events, key=lambda e: e[:2]):
            if run and equal(value, run[4], tolerance) and (not contiguous or at == run[2] + 1):
                run[2], run[3], run[4] = at, run[3] + 1, value
            else:
                run = [key, at, at, 1, value, value]
                out.append(run)
    return sorted(((r[0], r[5], r[1], r[2], r[3]) for r in out), key=str)


def collapse(spark, rows, **how):
    df = spark.createDataFrame(rows, "k string, at int, v double")
    got = collapse_runs(df, ["k"], "at", "v", **how).select("k", "v", "start", "end", "n_events")
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("range_len", [1, 3, 8, 1000])
def test_equals_brute_force(spark, seed, range_len):
    rng = random.Random(seed)
    rows = []
    for key in ("hot", "b", None):
        for at in rng.sample(range(-30, 90), 80 if key == "hot" else 40):
            rows.append((key, at, rng.choice([1.0, 1.0, 2.0, None])))
    assert collapse(spark, rows, range_len=range_len) == brute(rows)
    assert collapse(spark, rows, range_len=range_len, contiguous=False) == brute(rows, contiguous=False)


@pytest.mark.parametrize("range_len", [2, 7, 100])
def test_near_equal_chains(spark, range_len):
    rows = [("a", i, i * 0.4 if i % 10 else 50.0) for i in range(60)]
    assert collapse(spark, rows, tolerance=0.5, range_len=range_len) == brute(rows, 0.5)
    assert collapse(spark, [("a", i, 3.0) for i in range(50)], range_len=range_len) == [("a", 3.0, 0, 49, 50)]


def test_latest_row_holds_and_duration(spark):
    rows = [("a", 1, 1.0, 5), ("a", 1, 2.0, 9), ("a", 2, 2.0, 1), ("a", 2, 2.0, 1), ("a", 3, 4.0, 1)]
    df = spark.createDataFrame(rows, "k string, at int, v double, loaded int").withColumns({"b": F.col("at") * 30, "e": (F.col("at") + 1) * 30})
    got = collapse_runs(df, ["k"], "at", "v", latest_by="loaded", from_time="b", to_time="e").orderBy("start").collect()
    assert [(r["v"], r["start"], r["n_events"], r["duration"]) for r in got] == [(2.0, 1, 2, 60.0), (4.0, 3, 1, 30.0)]


def test_edge_cases(spark):
    assert collapse(spark, []) == []
    assert collapse(spark, [("a", None, 1.0)]) == []
    nan = float("nan")
    df = spark.createDataFrame([("a", 1, nan, 1, 1), ("a", 2, nan, 1, 1)], "k string, at int, v double, start int, range int")
    assert [r["n_events"] for r in collapse_runs(df, ["k"], "at", "v").collect()] == [2]
    repeated = [("a", 1, 5.0), ("a", 1, 5.0), ("a", 2, 5.0)]
    assert collapse(spark, repeated, contiguous=False) == [("a", 5.0, 1, 2, 3)]
