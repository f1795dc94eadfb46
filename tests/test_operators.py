"""Operators without a SQL twin, and edge cases of the others."""

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.operators import detect as D
from pulseloom.operators import intervals as I
from pulseloom.operators import matching as M
from pulseloom.operators import moving as V
from pulseloom.operators import noise as N
from pulseloom.operators import runs as R
from pulseloom.operators import templates as T
from pulseloom.operators import windows as S


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, i, v) for i, v in enumerate(values)], "k string, i long, v double")


@pytest.mark.parametrize("values,expected", [([1, 2, 2, 3, 3, 3, 4, 4, 4, 4, 2, 2], [(1, 1), (2, 2), (3, 3), (4, 4), (2, 2)]), ([], []), ([0, 1], [(0, 1), (1, 1)]), ([1, 1], [(1, 2)])])
def test_run_length_known_answers(spark, values, expected):
    got = R.encode_runs(series(spark, [float(v) for v in values]), ["k"], "i", "v").orderBy("run_no").collect()
    assert [(r["v"], r["n"]) for r in got] == expected


def test_run_length_nan_null_and_long_counts(spark):
    nan = float("nan")
    got = R.encode_runs(series(spark, [nan, nan, None, None, 1.0]), ["k"], "i", "v").orderBy("run_no").collect()
    assert [r["n"] for r in got] == [2, 2, 1]
    long = R.encode_runs(series(spark, [5.0] * 257), ["k"], "i", "v")
    assert [r["n"] for r in R.split_long_runs(long, "n", 255).orderBy("part_no").collect()] == [255, 2]


@pytest.mark.parametrize("seed", range(3))
def test_run_length_round_trip(spark, seed):
    rng = random.Random(seed)
    values = [float(rng.randrange(3)) for _ in range(rng.randrange(1, 200))]
    coded = R.encode_runs(series(spark, values), ["k"], "i", "v", stretch=16)
    back = R.decode_runs(coded, ["k"], "run_no", "v", "n", block=7).orderBy("position").collect()
    assert [r["v"] for r in back] == values and [r["position"] for r in back] == list(range(len(values)))


def test_frames_have_no_seams(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    df = series(spark, [None if i in (5, 100, 101, 102) else float(v) for i, v in enumerate(x)])
    for build in (
        lambda s: V.framed(df, ["k"], "i", 9, 9, lambda r, f, o: r.withColumn("out", F.avg(V._number("v")).over(f(-9, 9))), stretch=s),
        lambda s: V.framed(df, ["k"], "i", 4, 7, lambda r, f, o: r.withColumn("out", F.count("v").over(f(-4, 7))), stretch=s),
    ):
        assert rows(build(13)) == rows(build(100_000))
    wide = lambda s: V.framed(df, ["k"], "i", 50, 60, lambda r, f, o: r.withColumn("out", F.count("v").over(f(-50, 60))), stretch=s)
    assert rows(wide(10)) == rows(wide(100_000))  # a frame longer than the stretch


def test_frames_reach_over_positions_not_rows(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 10, 3.0), ("a", 11, 5.0), ("a", None, 9.0)], "k string, i long, v double")
    assert [r["moving_mean"] for r in V.moving_mean(df, ["k"], "i", "v", 3).orderBy("i").collect()] == [1.0, 4.0, 4.0]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k string, i long, v double")
    for df in (
        R.encode_runs(empty, ["k"], "i", "v"), R.cluster_by_gap(empty, ["k"], "i", 3), V.moving_mean(empty, ["k"], "i", "v", 5), V.smooth(empty, ["k"], "i", "v", 4, 3),
        V.step_outliers(empty, ["k"], "i", "v", 2.5, 10), V.mad_outliers(empty, ["k"], "v"), D.local_maxima(empty, ["k"], "i", "v"), D.thin_peaks(empty, ["k"], "i", "v", 5),
        D.weighted_vote(empty.withColumn("h", F.lit(1.0)), ["k"], "i", "v", "h", reach=2, least=1.0), D.label_cycles(empty, ["k"], "v"), I.merge_overlaps(empty.withColumn("j", F.col("i")), ["k"], "i", "j"),
        S.window_statistics(empty, ["k"], "v", ["i"], 10.0), S.smallest_mode(empty, ["k"], "v"), T.wave_scores(empty.withColumn("w", F.col("i")), ["k"], "w", "i", "v"),
    ):
        assert df.collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_thinned_peaks_equal_the_rule_over_all_peaks(spark, seed):
    rng = random.Random(seed)
    at = sorted(rng.sample(range(400), 90))
    heights = [rng.choice([1.0, 2.0, 3.0, rng.random()]) for _ in at]
    df = spark.createDataFrame([("a", i, h) for i, h in zip(at, heights)], "k string, i long, h double")
    alive, kept = set(at), []
    for i in sorted(range(len(at)), key=lambda i: (-heights[i], at[i])):
        if at[i] in alive:
            kept.append(at[i])
            alive -= {a for a in alive if abs(a - at[i]) < 6}
    assert [r["i"] for r in D.thin_peaks(df, ["k"], "i", "h", 6).orderBy("i").collect()] == sorted(kept)


def test_cycle_labels(spark):
    gaps = [0.8] * 6 + [1.6, 0.8, 0.5, 0.8, 0.95]
    times = np.cumsum([0.0, *gaps]).tolist()
    df = spark.createDataFrame([("a", t) for t in [*times, times[3]]] + [("b", 1.0), ("b", None)], "k string, t double")
    got = [r["label"] for r in D.label_cycles(df, ["k"], "t").orderBy("beat_at").collect()]
    assert got == ["start"] * 3 + ["ok"] * 3 + ["long", "ok", "short", "ok", "late"]
    assert D.judge_interval(2.0, deque([1.0, 1.0, 1.0]), 0.12, 1.6) == ("long", False)


def test_settled_pairs_use_each_valley_once(spark, sf_dir):
    from pulseloom.plans.interval_queries import settled_pairs, unmatched_valleys
    from pulseloom.plans.views import events_of

    pairs = settled_pairs(spark, sf_dir)
    used = pairs.where("ppg_sec is not null").groupBy("rec_id", "seg_id", "ppg_sec").count()
    assert used.agg(F.max("count")).first()[0] == 1
    peaks = events_of(spark, sf_dir, "r_peak").select("rec_id", "seg_id", "sec").distinct().count()
    assert pairs.where("r_sec is not null").count() == peaks
    assert unmatched_valleys(spark, sf_dir).count() > 0


def test_shared_valley_goes_to_the_nearer_peak(spark):
    both = spark.createDataFrame([("a", 1.0, 1.4), ("a", 1.5, 1.4), ("a", None, 1.9), ("a", 3.0, 3.1)], "k string, r double, p double")
    assert set(rows(M.settle_shared(both, ["k"], "r", "p"))) == {("a", 1.5, 1.4), ("a", 1.0, 1.9), ("a", 3.0, 3.1)}


def test_every_peak_gets_a_time(spark):
    both = spark.createDataFrame(
        [("a", 1.0, 1.2), ("a", 1.5, 1.2), ("a", 4.1, 4.0), ("a", None, 6.0)]  # the later peak searches 1.2 to 4.0
        + [("b", 1.0, 2.0), ("b", 2.0, 2.0), ("b", 3.0, 2.0), ("b", 5.0, None)],
        "k string, r double, p double",
    )
    wave = [("a", i / 100, -float(np.cos(2 * np.pi * (i / 100 - 1.2) / 1.4))) for i in range(700)]
    got = rows(M.settle_all(both, spark.createDataFrame(wave, "k string, t double, v double"), ["k"], "r", "p", "t", "v"))
    assert set(got) == {("a", 1.0, 1.2, "own"), ("a", 1.5, 2.6, "searched"), ("a", 4.1, 4.0, "own"), ("a", None, 6.0, "unpaired")} | {
        ("b", 2.0, 2.0, "own"), ("b", 1.0, 1.0, "peak"), ("b", 3.0, 3.0, "peak"), ("b", 5.0, 5.0, "peak")
    }


def test_implausible_segments_keep_their_valleys_unpaired(spark, monkeypatch):
    from pulseloom.plans import pipeline

    peaks = spark.createDataFrame([("a", n, float(i), 1.0) for n, m in ((1, 3), (2, 1), (3, 5), (4, 2)) for i in range(m)], "rec_id string, seg_id int, idx double, ecg_rate double")
    valleys = spark.createDataFrame([("a", n, i + 0.1, "valley") for n, m in ((1, 3), (2, 3), (3, 3)) for i in range(m)], "rec_id string, seg_id int, idx double, kind string")
    monkeypatch.setattr(pipeline.E, "voted_beats", lambda *_: peaks)
    monkeypatch.setattr(pipeline, "pulse_points", lambda *_: valleys)
    channels = spark.createDataFrame([("a", n, 1.0, None) for n in (1, 2, 3)], "rec_id string, seg_id int, fs double, x array<double>")
    got = pipeline.beats_and_pairs(peaks, channels).collect()
    assert {(r["seg_id"], r["r_sec"] is None) for r in got} == {(1, False), (2, True), (3, True)} and len(got) == 9


def test_interval_edges(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 10, 20), ("a", 5, 3), ("b", 7, 7)], "k string, s long, e long")
    assert rows(I.merge_overlaps(df, ["k"], "s", "e")) == [("a", 0, 20), ("b", 7, 7)]
    assert rows(I.split_at_bins(df.where("s < e"), "s", "e", 6)) == [("a", 0, 6, 0), ("a", 10, 12, 1), ("a", 12, 18, 2), ("a", 18, 20, 3), ("a", 6, 10, 1)]
    bounds = spark.createDataFrame([("a", 0, 25), ("b", 0, 9), ("c", 3, 4)], "k string, low long, high long")
    free = I.complement(I.merge_overlaps(df, ["k"], "s", "e"), bounds, ["k"], "s", "e", "low", "high")
    assert rows(free) == [("a", 20, 25), ("b", 0, 7), ("b", 7, 9), ("c", 3, 4)]
    layout = I.bin_layout(spark.createDataFrame([("a", 23), ("b", 27), ("c", 4), ("d", 0), ("e", None)], "k string, n long"), ["k"], "n", 10)
    assert rows(layout) == [("a", 0, 0, 10), ("a", 1, 10, 23), ("b", 0, 0, 10), ("b", 1, 10, 20), ("b", 2, 20, 27), ("c", 0, 0, 4)]


def test_short_pieces_at_a_border_are_joined(spark):
    df = spark.createDataFrame(
        [("a", 60, 100, "right"), ("a", 100, 140, "left"), ("b", 80, 100, "right"), ("b", 100, 130, "left"), ("b", 150, 200, "stay")]
        + [("c", 90, 100, "right"), ("c", 100, 110, "left"), ("d", 80, 100, "right"), ("d", 101, 130, "left"), ("d", 0, 5, "drop")],
        "k string, s long, e long, move string",
    )
    got = rows(I.merge_moving(df, ["k"], "s", "e", 60, join_short=True))
    assert got == [("a", 60, 140, "stay"), ("b", 150, 200, "stay"), ("b", 80, 130, "left"), ("c", 90, 110, "right"), ("d", 101, 130, "left"), ("d", 80, 100, "right")]
    assert ("c", 90, 100, "right") in rows(I.merge_moving(df, ["k"], "s", "e", 60))


def test_pipeline_keeps_clean_time_around_a_border(spark):
    from pulseloom.plans.pipeline import clean_segments

    noise = spark.createDataFrame([("a", 0, 700_000), ("a", 1_100_000, 2_700_000)], "rec_id string, s long, e long")
    lengths = spark.createDataFrame([("a", 2_700_000)], "rec_id string, length_ms long")
    # 200 s on both sides of 900 s are 400 s, under 450 s: they move, and nothing stays; 250 s and 200 s are enough
    assert clean_segments(noise, lengths).count() == 0
    noise = spark.createDataFrame([("a", 0, 650_000), ("a", 1_100_000, 2_700_000)], "rec_id string, s long, e long")
    assert rows(clean_segments(noise, lengths)) == [("a", 0, 650_000, 1_100_000)]


def test_points_in_long_intervals(spark):
    spans = spark.createDataFrame([("a", 0, 10_000_000), ("a", 20_000_000, 20_000_000)], "k string, s long, e long")
    points = spark.createDataFrame([("a", 5), ("a", 5), ("a", 10_000_000), ("a", 10_000_001), ("a", 20_000_000), ("b", 5), ("a", None)], "k string, at long")
    assert rows(I.points_in_intervals(points, spans, ["k"], "at", "s", "e", cell=1000)) == [("a", 10_000_000), ("a", 20_000_000), ("a", 5), ("a", 5)]
    assert I.points_in_intervals(points, spans, ["k"], "at", "s", "e", cell=1000, keep="outside").count() == 3


def test_automatic_noise_finds_a_bad_window_and_a_flat_stretch(spark):
    t = np.arange(6000) / 100
    x = np.sin(2 * np.pi * t) + np.random.default_rng(1).normal(0, 0.01, 6000)
    x[2000:2100] *= 30
    x[4000:4200] = 0.5
    got = N.automatic_noise(series(spark, [float(v) for v in x]), ["k"], "i", "v", window=200, flat=50, join=100, widen=20).orderBy("low").collect()
    assert len(got) == 2
    assert got[0]["low"] <= 2000 and got[0]["high"] >= 2100 and abs(got[1]["low"] - 4000) < 60 and abs(got[1]["high"] - 4200) < 60


def test_template_of_equal_waves_is_the_wave(spark):
    wave = [0.0, 1.0, 4.0, 2.0, 0.5]
    df = spark.createDataFrame([("a", w, o, v) for w in range(4) for o, v in enumerate(wave)], "k string, w int, o int, v double")
    assert [r["template"] for r in T.template(df, ["k"], "o", "v").orderBy("o").collect()] == wave
    assert {r["correlation"] for r in T.correlation_to_template(df, T.template(df, ["k"], "o", "v"), ["k"], "w", "o", "v").select(F.round("correlation", 9).alias("correlation")).collect()} == {1.0}
    assert T.good_waves(df, ["k"], "w", "o", "v").count() == 20


def test_similarity_edge_cases(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0]), (2, None, [1.0, 2.0]), (3, [], [1.0]), (4, [1.0, 1.0], [1.0, 2.0]), (5, [1.0, None, 3.0], [1.0, 3.0])], "id int, a array<double>, b array<double>")
    got = {r["id"]: r for r in T.similarity_to_template(df, ["id"], "a", "b").collect()}
    assert got[1]["warp"] == 0 and got[1]["frechet"] == 0 and abs(got[1]["correlation"] - 1) < 1e-9
    assert got[2]["warp"] is None and got[3]["correlation"] is None and got[4]["correlation"] is None and got[5]["warp"] == 0


def test_quality_classes(spark):
    scores = [(95.0, 92.0, 91.0, 90.0), (95.0, 92.0, 10.0, 91.0), (85.0, 82.0, 40.0, 75.0), (75.0, 80.0, 72.0, 70.0), (75.0, 80.0, 10.0, 0.0), (0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(scores, "a double, b double, c double, d double")
    assert [r[0] for r in df.select(T.quality_class(*map(F.col, "abcd"))).collect()] == ["E", "A", "A", "A", "Q", "Q"]


def test_nearest_stretch_is_the_planted_one(spark):
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=500), np.sin(np.arange(40) / 5)
    x[123:163] = 3 * q + 7
    df = spark.createDataFrame([("a", [float(v) for v in x]), ("b", None), ("c", [1.0]), ("d", [1.0] * 99)], "k string, x array<double>")
    got = T.nearest_stretches(df, ["k"], "x", q.tolist(), 2).orderBy("rank").collect()
    assert [(r["k"], r["idx"]) for r in got][0] == ("a", 123) and len(got) == 2 and got[0]["distance"] < 1e-3


def test_broadcast_only_below_the_bound(spark):
    from pulseloom.functions.common import broadcast_if_small

    small, right = spark.range(10), spark.range(100)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(right.join(broadcast_if_small(small), "id"))
    assert "broadcast" not in plan(right.join(broadcast_if_small(small, max_bytes=10), "id"))


@pytest.mark.parametrize("seed", range(3))
def test_exact_median_over_all_ranges(spark, seed):
    rng = random.Random(seed)
    pick = lambda: rng.choice([0.0, -0.0, 1e-300, 5e-324, -1e300, float("inf"), -float("inf"), rng.gauss(0, 1), rng.gauss(0, 1e-9), -3.5, 2.0, None, float("nan")])
    data = [(rng.choice(["hot"] * 5 + ["a", None]), pick()) for _ in range(rng.choice([30, 301]))] + [("none", None)]
    got = {r["k"]: r["m"] for r in V.exact_median(spark.createDataFrame(data, "k string, v double"), ["k"], F.col("v"), "m").collect()}
    by = {}
    for k, v in data:
        if v is not None and v == v:
            by.setdefault(k, []).append(v)
    assert set(got) == set(by)
    for k, own in by.items():
        own.sort()
        low, high = own[(len(own) - 1) // 2], own[len(own) // 2]
        middle = (low + high) / 2
        assert got[k] == middle or (got[k] != got[k] and middle != middle)


def test_hot_entities_are_joined_to_their_bounds(spark):
    from pulseloom.operators import features as B

    rows_ = [("hot" if i % 2 else None, i // 40, float(i), 0 if i % 5 else 2) for i in range(200)]
    df = spark.createDataFrame(rows_, "k string, part int, at double, stage int")
    flags = {r["at"]: r["is_edge"] for r in B.edge_flags(df, ["k"], "part", "at").collect()}
    for key in ("hot", None):
        own = [r for r in rows_ if r[0] == key]
        for p in range(5):
            places = [r[2] for r in own if r[1] == p]
            for at in places:
                assert flags[at] == (at in (places[0], places[-1]) and at not in (own[0][2], own[-1][2]))
    since = {r["at"]: r["since_onset"] for r in B.sleep_onsets(df, ["k"], "at", "stage").collect()}
    first = {key: min(r[2] for r in rows_ if r[0] == key and r[3] != 0) for key in ("hot", None)}
    assert all(since[r[2]] == r[2] - first[r[0]] for r in rows_)


def test_nearest_in_series_over_cells(spark):
    rng = random.Random(8)
    left = [(k, rng.randrange(400) / 2) for k in ["a"] * 60 + [None] * 5 + ["none"]] + [("a", None)]
    right = [(k, rng.randrange(400) / 2) for k in ["a"] * 25 + [None] * 3 + ["other"]]
    frames = spark.createDataFrame(left, "k string, t double"), spark.createDataFrame(right, "k string, u double")
    for cell in (7, 1000):
        got = {(r["k"], r["t"]): r["u"] for r in M.nearest_in_series(*frames, ["k"], "t", "u", cell=cell).collect()}
        assert set(got) == {(k, t) for k, t in left if t is not None}
        for (k, t), u in got.items():
            own = [v for j, v in right if j == k]
            assert u == (min(own, key=lambda v: (abs(v - t), v)) if own else None)
    assert M.nearest_in_series(frames[0].limit(0), frames[1], ["k"], "t", "u", cell=7).collect() == []


def test_concatenated_rows_and_their_way_back(spark):
    from pulseloom.operators import features as B

    rng = random.Random(9)
    data = [(k, rng.randrange(300), i) for i, k in enumerate(["a"] * 70 + [None] * 10)] + [("a", None, 99)]
    df = spark.createDataFrame(data, "k string, at long, i int")
    for cell in (11, 1000):
        got = {r["i"]: r["position"] for r in B.concatenated(df, ["k"], ["at", "i"], cell=cell).collect()}
        for k in ("a", None):
            own = sorted((a, i) for j, a, i in data if j == k and a is not None)
            assert [got[i] for _, i in own] == list(range(len(own)))
    pieces = spark.createDataFrame([("a", 0, 10, 100), ("a", 10, 5, 300)], "k string, offset long, length long, begin long")
    points = spark.createDataFrame([("a", p) for p in (0, 9, 10, 14, 15)] + [("b", 1)], "k string, at long")
    got = {r["at"]: r["position"] for r in B.original_positions(points, pieces, ["k"], "at", "offset", "length", "begin", cell=4).collect()}
    assert got == {0: 100, 9: 109, 10: 300, 14: 304}
