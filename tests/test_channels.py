"""Array channels against the long-form operators, over chunks of any size, and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.operators import channels as C
from pulseloom.operators import detect as D
from pulseloom.operators import features as B
from pulseloom.operators import moving as V


def wave(n, seed):
    rng = random.Random(seed)
    x = [round(float(3 * np.sin(i / 9)) + rng.gauss(0, 0.4), 3) for i in range(n)]
    for _ in range(n // 12):
        x[rng.randrange(n)] = rng.choice([None, float("nan"), float("inf")])
    low = rng.randrange(n // 2)
    x[low : low + 15] = [None] * 15
    return x


@pytest.fixture(scope="module")
def arrays(spark):
    rows = [("a", wave(700, 1)), ("b", wave(90, 2)), (None, wave(130, 3)), ("flat", [1.5] * 60), ("one", [2.0]), ("none", [None] * 40), ("empty", []), ("null", None)]
    return spark.createDataFrame(rows, "k string, x array<double>").withColumns({"soft": F.lit(6), "wide": F.lit(31), "IDX": F.lit("other")}).cache()


def long_form(df):
    return df.select("k", F.posexplode("x").alias("idx", "v"))


def near(df, *columns):
    return sorted(((r["k"] or "", *(None if r[c] is None else round(float(r[c]) + 3e-10, 8) if isinstance(r[c], float) else r[c] for c in columns)) for r in df.collect()), key=repr)


CASES = {
    "mean": (lambda d: C.moving_mean(d, ["k"], "x", 8), lambda d: V.moving_mean(d, ["k"], "idx", "v", 8), "moving_mean"),
    "std": (lambda d: C.moving_std(d, ["k"], "x", 9), lambda d: V.moving_std(d, ["k"], "idx", "v", 9), "moving_std"),
    "smooth": (lambda d: C.smooth(d, ["k"], "x", 6, 2), lambda d: V.smooth(d, ["k"], "idx", "v", 6, 2), "smooth"),
    "slope": (lambda d: C.rolling_slope(d, ["k"], "x", 5), lambda d: V.rolling_slope(d, ["k"], "idx", "v", 5), "rolling_slope"),
    "middle": (lambda d: C.middle_mean_residual(d, ["k"], "x", 7), lambda d: V.middle_mean_residual(d, ["k"], "idx", "v", 7), "residual"),
    "median": (lambda d: C.fill_with_trailing_median(d, ["k"], "x", 9), lambda d: V.fill_with_trailing_median(d, ["k"], "idx", "v", 9), "filled"),
    "forward": (lambda d: C.fill_forward(d, ["k"], "x", missing_below=-2.0), lambda d: V.fill_forward(d, ["k"], "idx", "v", missing_below=-2.0, stretch=20), "filled"),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("size", [11, 100_000])
def test_sample_operators_equal_the_long_form(spark, arrays, monkeypatch, name, size):
    chunked = C.chunked
    monkeypatch.setattr(C, "chunked", lambda df, samples, before, after: chunked(df, samples, before, after, size=size))
    made, plain, column = CASES[name]
    assert near(made(arrays), "idx", column) == near(plain(long_form(arrays)), "idx", column)


@pytest.mark.parametrize("size", [40, 100_000])
@pytest.mark.parametrize("direction", ["both", "upper"])
def test_steps_and_valleys_equal_the_long_form(spark, arrays, monkeypatch, size, direction):
    chunked = C.chunked
    monkeypatch.setattr(C, "chunked", lambda df, samples, before, after: chunked(df, samples, before, after, size=size))
    known = arrays.where("k is not null and k <> 'flat'")
    plain = V.step_outliers(long_form(known), ["k"], "idx", "v", 1.5, 12, direction).where("outlier")
    assert near(C.step_outliers(known, ["k"], "x", 1.5, 12, direction), "idx") == near(plain, "idx")
    valleys = D.pulse_valleys_and_peaks(long_form(known), ["k"], "idx", "v", smooth_width=6, mean_width=31)
    assert near(C.pulse_valleys_and_peaks(known, ["k"], "x", smooth_width="soft", mean_width="wide"), "run_no", "kind", "idx", "value") == near(valleys, "run_no", "kind", "idx", "v")


@pytest.mark.parametrize("size", [50, 100_000])
def test_beat_measures_equal_the_long_form(spark, arrays, size, monkeypatch):
    known = arrays.where("k is not null")
    marks = C.pulse_valleys_and_peaks(known, ["k"], "x", smooth_width="soft", mean_width="wide").where("kind = 'valley'").select("k", "idx")
    over = C.over_beats
    monkeypatch.setattr(C, "over_beats", lambda *a, **k: over(*a, **k, size=size))
    got = C.beat_measures(known, C.beat_bounds(marks.union(marks), ["k"]), ["k"], "x")
    samples = B.samples_by_beat(long_form(known), marks, ["k"], "idx", "idx")
    shapes = B.beat_shapes(samples, ["k"], "v").drop("fall_offset")
    marked = B.beat_landmarks(samples, ["k"], "v")
    for plain in (shapes, marked):
        names = [c for c in plain.columns if c != "k"]
        assert near(got, *names) == near(plain, *names)
    assert got.count() >= 15


def test_long_frames_empty_tables_and_null_keys(spark, arrays):
    assert C.moving_mean(arrays, ["k"], "x", 100_001).where("k = 'flat'").select("moving_mean").distinct().collect() == [(1.5,)]
    assert C.moving_mean(arrays, ["k"], "x", 3).where("k is null").count() == 130
    none = arrays.limit(0)
    for df in (C.smooth(none, ["k"], "x", 5), C.step_outliers(none, ["k"], "x", 2.0, 5), C.fill_forward(none, ["k"], "x"), C.pulse_valleys_and_peaks(none, ["k"], "x", smooth_width="soft", mean_width="wide")):
        assert df.collect() == []
    bounds = spark.createDataFrame([("a", 0, 5, 30), ("zz", 0, 1, 2)], "k string, beat_no int, low long, high long")
    assert C.beat_measures(none, bounds, ["k"], "x").collect() == []
    assert C.beat_measures(arrays, bounds.limit(0), ["k"], "x").collect() == []
    assert [r["k"] for r in C.beat_measures(arrays, bounds, ["k"], "x").collect()] == ["a"]


def test_beat_quality_tells_odd_beats(spark):
    from pulseloom.operators import templates as T

    rng = np.random.default_rng(7)
    beat = 100 * np.sin(np.linspace(0, np.pi, 80)) ** 2
    x = np.concatenate([beat * rng.uniform(0.95, 1.05) + rng.normal(0, 0.3, 80) if i != 6 else rng.normal(50, 30, 80) for i in range(12)])
    df = spark.createDataFrame([("a", 100.0, [float(v) for v in x]), (None, 100.0, [1.0] * 300)], "k string, fs double, x array<double>")
    bounds = spark.createDataFrame([("a", i, i * 80, (i + 1) * 80) for i in range(11)] + [(None, 0, 0, 90), ("zz", 0, 0, 5)], "k string, beat_no int, low long, high long")
    rows = {(r["k"], r["beat_no"]): r for r in T.beat_quality(C.beat_waves(df, bounds, ["k"], "x", "fs"), ["k"]).collect()}
    assert len(rows) == 12
    assert all(rows["a", i]["direct"] > 95 and rows["a", i]["quality_class"] in "EA" for i in range(11) if i != 6)
    assert rows["a", 6]["direct"] < 60 and rows["a", 6]["quality_class"] == "Q"
    assert (rows[None, 0]["direct"], rows[None, 0]["moving"], rows[None, 0]["quality_class"]) == (0, 0, "Q")
    capped = C.beat_waves(df, spark.createDataFrame([("a", 0, 0, 900)], "k string, beat_no int, low long, high long"), ["k"], "x", "fs").first()
    assert len(capped["wave"]) == 301


def test_timings_positions_and_delays_of_a_plain_beat(spark):
    x = [0.0, 2.0, 6.0, 10.0, 8.0, 5.0, 6.0, 3.0, 1.0]
    df = spark.createDataFrame([("a", 100.0, 1000, x)], "k string, fs double, begin long, x array<double>")
    bounds = spark.createDataFrame([("a", 0, 0, 8)], "k string, beat_no int, low long, high long")
    rows = C.beat_measures(df, bounds, ["k"], "x", carry=("fs", "begin"))
    got = B.delays_from_peak(B.beat_positions(B.beat_timings(rows, "fs"), "begin").withColumns({"r": F.lit(9.9), "at": F.lit(10.0)}), "r", "at").first()
    assert (got["idx_begin"], got["idx_peak"], got["idx_end"], got["up_50"]) == (1000, 1003, 1008, 1.75)
    assert got["up_end_80"] == pytest.approx(1 + 0.8 / 4) and got["level_end_80"] == pytest.approx(2.8)  # a fifth of the way from the end up to the peak
    assert got["ms_half_to_peak"] == pytest.approx(12.5) and got["ms_length"] == 80 and got["peak_over_begin"] == 10 and got["end_over_begin"] == 1
    assert got["ms_r_to_begin"] == pytest.approx(100) and got["ms_r_to_peak"] == pytest.approx(130)
