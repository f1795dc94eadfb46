import random

import pytest
from pyspark.sql import functions as F

from pulseloom.llm.nearest_time import match_nearest_time


def brute(left, right, tolerance):
    out = []
    for key, t, tag in left:
        best = None
        if key is not None and t is not None and t == t:
            for k, u, v in right:
                if k == key and u is not None and u == u and abs(u - t) <= tolerance:
                    order = (abs(u - t), u, (v is not None, v if v is not None else 0))
                    if best is None or order < best[0]:
                        best = (order, v, abs(u - t))
        out.append((key, t, tag, best and best[1], best and best[2]))
    return out


def rows(seq):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in map(lambda v: None if v != v else v, r)) for r in seq), key=str)


def match(spark, left, right, tolerance, **how):
    a = spark.createDataFrame(left, "k string, t double, tag int")
    b = spark.createDataFrame(right, "k string, u double, v int")
    return match_nearest_time(a, b, ["k"], "t", "u", tolerance, {"v": "v"}, **how)


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot", "hot", "hot", "b", "c", None])
    time = lambda: rng.choice([rng.uniform(-50, 50), float(rng.randrange(-20, 20)), None, float("nan")])
    left = [(key(), time(), i) for i in range(300)]
    right = [(key(), time(), rng.choice([None, 1, 2, 3])) for _ in range(300)]
    got = match(spark, left, right, 1.5, range_len=4.0)
    assert rows(map(tuple, got.collect())) == rows(brute(left, right, 1.5))


def test_ranges_and_batches_have_no_seams(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        left = [("a", i * 0.31, i) for i in range(400)]
        right = [("a", i * 0.47 + 0.1, i) for i in range(300)] + [("a", i * 0.47 + 0.1, i + 1) for i in range(0, 300, 3)]
        got = match(spark, left, right, 0.2, range_len=1.0)
        assert rows(map(tuple, got.collect())) == rows(brute(left, right, 0.2))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tie_takes_the_earlier_and_tolerance_is_inclusive(spark):
    got = match(spark, [("a", 1.0, 0), ("a", 10.0, 1)], [("a", 0.5, 7), ("a", 1.5, 8), ("a", 10.5, 9)], 0.5).orderBy("tag").collect()
    assert [r["v"] for r in got] == [7, 9]


def test_inner_distinct_and_repeats(spark):
    left, right = [("a", 1.0, 0), ("a", 1.0, 0), ("a", 99.0, 1), (None, 1.0, 2)], [("a", 1.1, 5), ("a", 1.1, 5)]
    assert match(spark, left, right, 0.5).count() == 4
    once = match(spark, left, right, 0.5, how="inner", distinct=True).collect()
    assert [(r["k"], r["tag"], r["v"]) for r in once] == [("a", 0, 5)]


def test_empty_tables_and_clashing_columns(spark):
    assert match(spark, [], [("a", 1.0, 1)], 1.0).collect() == []
    assert [r["v"] for r in match(spark, [("a", 1.0, 1)], [], 1.0).collect()] == [None]
    a = spark.createDataFrame([("a", 1.0, "x", [1, 2])], "k string, t double, __side string, u array<int>")
    b = spark.createDataFrame([("a", 1.2, 3)], "k string, u double, t int")
    got = match_nearest_time(a, b, ["k"], "t", "u", 1.0, {"t": "right_t"}).first()
    assert (got["__side"], got["u"], got["right_t"]) == ("x", [1, 2], 3)
    with pytest.raises(ValueError):
        match_nearest_time(a, b, ["k"], "t", "u", 1.0, {"u": "u"})


def test_timestamps(spark):
    a = spark.sql("SELECT 'a' AS k, timestamp'2024-01-01 00:00:00' AS t")
    b = spark.sql("SELECT 'a' AS k, timestamp'2024-01-01 00:00:02' AS u, 1 AS v")
    assert match_nearest_time(a, b, ["k"], "t", "u", 5.0, {"v": "v"}).select(F.round("time_distance", 6)).first()[0] == 2.0
