"""Regular grids, control charts and interval islands: brute force and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.operators import control_charts
from pulseloom.operators.control_charts import flag_implausible, flag_implausible_readings, flag_matrix
from pulseloom.operators.interval_islands import merge_intervals
from pulseloom.operators.regular_grid import regular_grid


# ---- interval islands


def brute_islands(rows, touch=1):
    out, by = [], {}
    for key, a, b in rows:
        if a is not None and b is not None:
            by.setdefault(key, []).append((min(a, b), max(a, b)))
    for key, spans in by.items():
        periods, longest = [], {}
        for a, b in spans:
            longest[a] = max(b, longest.get(a, b))
        for a, b in sorted(longest.items()):
            if periods and a <= periods[-1][1] + touch:
                periods[-1][1] = max(periods[-1][1], b)
            else:
                periods.append([a, b])
        out += [(key, "period", a, b) for a, b in periods]
        out += [(key, "gap", p[1] + 1, q[0] - 1) for p, q in zip(periods, periods[1:]) if q[0] > p[1] + 1]
    return sorted(out, key=str)


def islands(spark, rows, **how):
    df = spark.createDataFrame(rows, "k string, a long, b long")
    return sorted(map(tuple, merge_intervals(df, ["k"], "a", "b", **how).collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("touch", [1, 0])
def test_islands_equal_brute_force(spark, seed, touch):
    rng = random.Random(seed)
    rows = []
    for _ in range(600):
        key = rng.choice(["hot"] * 6 + ["a", "b", None])
        low = rng.randrange(4000)
        rows.append((key, low, low + rng.choice([0, 1, 3, 10, 400 if seed % 2 else 5])))
    assert islands(spark, rows, touch=touch) == brute_islands(rows, touch)


def test_islands_over_many_parts_of_one_entity(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [("hot", i * 7, i * 7 + (3 if i % 50 else 900)) for i in range(500)]
        assert islands(spark, rows) == brute_islands(rows)
        one = [("hot", 0, 10_000), *rows, ("z", 5, 6)]  # one period over every part
        assert islands(spark, one) == brute_islands(one)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize(("parts", "batch"), [(1, 1), (1, 7), (2, 2), (3, 1), (5, 7), (16, 1), (16, 2), (64, 7), (64, 10_000)])
def test_islands_do_not_depend_on_parts_and_batches(spark, parts, batch):
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": str(parts), "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)}
    before = {k: spark.conf.get(k) for k in names}
    rng = random.Random(parts * 1000 + batch)
    rows = []
    for i in range(400):  # chains of intervals that lengthen the one before, so that islands grow across borders
        low = i * 10 + rng.randrange(4)
        rows.append((rng.choice(["hot"] * 4 + ["a", None]), low, low + rng.choice([0, 4, 8, 12, 25, 60, 300])))
    big = 2**55
    rows += [("big", big + a, big + b) for a, b in ((1, 2), (3, 3), (5, 9), (8, 12), (13, 14))]
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        for touch in (1, 0, -1):
            assert islands(spark, rows, touch=touch) == brute_islands(rows, touch)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_islands_survive_a_later_coalesce_and_union(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [("hot", i * 7, i * 7 + (3 if i % 50 else 900)) for i in range(500)]
        found = merge_intervals(spark.createDataFrame(rows, "k string, a long, b long"), ["k"], "a", "b")
        assert sorted(map(tuple, found.coalesce(1).collect()), key=str) == brute_islands(rows)
        other = spark.createDataFrame([("x", "period", 1, 2)], found.schema)
        assert sorted(map(tuple, other.union(found).collect()), key=str) == sorted([("x", "period", 1, 2), *brute_islands(rows)], key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_islands_edge_cases(spark):
    assert islands(spark, []) == []
    rows = [("a", 5, 3), ("a", None, 9), ("a", 6, None), ("a", 6, 6), ("a", 6, 6), (None, 1, 2), (None, 4, 4), ("b", 1, 100), ("b", 20, 30), ("b", 102, 103)]
    assert islands(spark, rows) == brute_islands(rows)
    wide = spark.createDataFrame(rows, "k string, a long, b long").withColumns({"low": F.lit("x"), "k0": F.lit(1), "HIGH": F.lit(None)})
    assert sorted(map(tuple, merge_intervals(wide, ["k"], "a", "b").collect()), key=str) == brute_islands(rows)


# ---- regular grid


def brute_grid(rows, step, limit):
    out, by = [], {}
    for key, t, v in rows:
        if t is not None and v is not None and t == t and v == v:
            by.setdefault(key, []).append((t, v))
    for key, readings in by.items():
        readings.sort()
        slots = [int(t // step) for t, _ in readings]
        for slot in range(slots[0], slots[-1] + 1):
            own = [v for t, v in readings if int(t // step) == slot]
            at = slot * step
            before, after = [r for r in readings if r[0] < at], [r for r in readings if r[0] >= at]
            value = None
            if after and after[0][0] == at:
                value = after[0][1]
            elif before and after and after[0][0] - before[-1][0] <= limit:
                (t0, v0), (t1, v1) = before[-1], after[0]
                value = v0 + (v1 - v0) * (at - t0) / (t1 - t0)
            status = "observed" if own else "filled" if value is not None else "gap"
            out.append((key, slot, status, len(own), sum(own) / len(own) if own else None, value))
    return out


def near(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in map(tuple, rows)), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_grid_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.choice([rng.uniform(0, 900), float(rng.randrange(90) * 10), None]), rng.choice([rng.uniform(-5, 5), 1.0, None, float("nan")])) for _ in range(120)]
    df = spark.createDataFrame(rows, "k string, t double, v double")
    got = regular_grid(df, ["k"], "t", "v", 10.0, gap_limit=25.0).select("k", "slot_no", "status", "n_readings", "slot_mean", "value")
    assert near(got.collect()) == near(brute_grid(rows, 10.0, 25.0))


def test_grid_long_gaps_and_stretches(spark):
    rows = [("a", 5.0, 1.0), ("a", 300_005.0, 2.0), ("a", 300_006.0, 4.0), ("b", 7.0, 3.0)]
    got = regular_grid(spark.createDataFrame(rows, "k string, t double, v double"), ["k"], "t", "v", 1.0, gap_limit=1e9)
    assert got.where("k = 'a'").count() == 300_002
    middle = got.where("k = 'a' and slot_no = 150005").first()
    assert middle["status"] == "filled" and abs(middle["value"] - 1.5) < 1e-9
    assert got.where("k = 'a' and status = 'observed'").count() == 3


def test_grid_edge_cases(spark):
    empty = spark.createDataFrame([], "k string, t double, v double")
    assert regular_grid(empty, ["k"], "t", "v", 10.0, gap_limit=1.0).collect() == []
    clash = spark.createDataFrame([("a", 1.0, 2.0, 9, 9)], "k string, t double, v double, slot int, n int")
    assert regular_grid(clash, ["k"], "t", "v", 10.0, gap_limit=1.0).count() == 1


# ---- implausible readings


def pulse(n=2000, fs=100.0, seed=1):
    rng = np.random.default_rng(seed)
    t = np.arange(n) / fs
    return np.sin(2 * np.pi * 1.2 * t) + 0.3 * np.sin(2 * np.pi * 2.4 * t) + rng.normal(0, 0.01, n)


def flags(spark, rows, factor=0.7):
    df = spark.createDataFrame(rows, "id string, x array<double>, rate double").withColumn("factor", F.lit(factor))
    return sorted(map(tuple, flag_implausible(df, ["id"], "x", "rate", "factor").collect()), key=str)


def test_spikes_held_and_impossible(spark):
    x = pulse()
    x[500] += 3
    x[800:803] -= 2.5
    x[1200:1225] = x[1200]
    x[1500], x[1600] = np.inf, 2000.0
    x[700] = np.nan
    got = flags(spark, [("a", [float(v) for v in x], 100.0)])
    expected = [("a", 500, "spike")] + [("a", i, "spike") for i in range(800, 803)] + [("a", i, "held") for i in range(1200, 1225)] + [("a", 1500, "impossible"), ("a", 1600, "impossible")]
    assert got == sorted(expected, key=str)


def test_clean_channel_has_no_flags(spark):
    assert flags(spark, [("a", [float(v) for v in pulse(seed=5)], 100.0)]) == []


def test_implausible_edge_cases(spark):
    rows = [("absent", [-1.0], 100.0), ("none", None, 100.0), ("empty", [], 100.0), ("norate", [1.0, 2.0], None), ("nulls", [None, None, None], 100.0), ("flat", [1.0] * 30, 100.0), (None, [1.0, 5000.0, 1.0], 10.0)]
    got = flags(spark, rows)
    assert {g[0] for g in got} == {"flat", None}
    assert len([g for g in got if g[0] == "flat"]) == 30
    assert flags(spark, []) == []
    twice = flags(spark, [("a", [1.0, 5000.0, 1.0], 10.0)] * 2)
    assert twice == [("a", 1, "impossible")] * 2


def test_long_channels_are_cut_without_seams(spark, monkeypatch):
    x = pulse(5000)
    for at in (999, 1000, 1999, 3001):
        x[at] += 3
    x[2990:3020] = x[2990]
    whole = flags(spark, [("a", [float(v) for v in x], 100.0)])
    monkeypatch.setattr(control_charts, "PIECE", 1000)
    import pyspark.cloudpickle as cloudpickle

    cloudpickle.register_pickle_by_value(control_charts)  # the tasks see the small piece length
    try:
        pieces = flags(spark, [("a", [float(v) for v in x], 100.0)])
    finally:
        cloudpickle.unregister_pickle_by_value(control_charts)
    assert pieces == whole


def test_readings_in_long_form(spark):
    x = pulse(3000)
    x[1000] += 3
    rows = [("a", i, float(v)) for i, v in enumerate(x) if not 1500 <= i < 1540] + [("a", None, 1.0), ("a", 5, float(x[5])), ("a", 70_000, 5000.0), ("b", 0, None), ("b", 1, 1.0)]
    df = spark.createDataFrame(rows, "k string, i long, v double")
    got = flag_implausible_readings(df, ["k"], "i", "v", rate=100.0, spike_factor=0.7).collect()
    assert sorted(map(tuple, got)) == [("a", 1000, "spike"), ("a", 70_000, "impossible")]


def test_chart_candidates_hold_every_true_spike():
    rng = np.random.default_rng(3)
    for seed in range(20):
        x = pulse(1500, seed=seed)
        at = rng.choice(np.arange(50, 1450, 10), 8, replace=False)
        x[at] += rng.choice([-1, 1], 8) * rng.uniform(2.6, 6, 8)
        found = flag_matrix(x[None], np.array([100.0]), np.array([0.7]), physical_limit=1000, held_sec=0.2, window_sec=1.6, weight=0.02, limit=5.0)
        assert set(at) <= {int(p) for _, pos, kind in found if kind == "spike" for p in pos}
