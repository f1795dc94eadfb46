"""Beats by the vote of detectors, on synthetic channels with known beats."""

import numpy as np
import pytest

from pulseloom.operators.beats import beat_votes, energy_peaks, two_level_peaks, voted_beats


def channel(fs, bpm, seconds, seed, noise=0.05):
    """A channel of narrow R waves, broad T waves, drift and noise, and the positions of its R waves."""
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * fs)) / fs
    x = 0.3 * np.sin(2 * np.pi * 0.2 * t) + rng.normal(0, noise, len(t))
    beats, at = [], 0.4
    while at < seconds - 0.4:
        beats.append(int(round(at * fs)))
        x += 1.5 * np.exp(-(((t - at) / 0.012) ** 2)) + 0.3 * np.exp(-(((t - at - 0.25) / 0.05) ** 2))
        at += 60 / bpm * (1 + rng.normal(0, 0.03))
    return x, np.array(beats)


def score(found, truth, reach):
    near = lambda a, b: np.mean([np.abs(b - i).min() <= reach for i in a]) if len(a) and len(b) else 0.0
    return near(truth, found), near(found, truth)


@pytest.mark.parametrize(("fs", "bpm", "noise"), [(125.0, 60, 0.05), (256.0, 75, 0.05), (256.0, 110, 0.1), (500.0, 90, 0.05)])
def test_votes_find_the_beats(spark, fs, bpm, noise):
    made = [channel(fs, bpm, 60, s, noise) for s in range(3)]
    df = spark.createDataFrame([(i, fs, x.tolist()) for i, (x, _) in enumerate(made)], "k int, fs double, x array<double>")
    rows = voted_beats(df, ["k"], "x", "fs").collect()
    for i, (_, truth) in enumerate(made):
        sensitivity, precision = score(np.array(sorted(r["idx"] for r in rows if r["k"] == i)), truth, 0.03 * fs)
        assert sensitivity >= 0.97 and precision >= 0.97, (sensitivity, precision)


def test_long_channels_are_cut_without_losing_or_doubling_beats(spark):
    x, truth = channel(125.0, 70, 300, 9)
    df = spark.createDataFrame([("a", 125.0, x.tolist())], "k string, fs double, x array<double>")
    found = np.array(sorted(r["idx"] for r in voted_beats(df, ["k"], "x", "fs", size=2_000).collect()))
    sensitivity, precision = score(found, truth, 4)
    assert sensitivity >= 0.98 and precision >= 0.98 and np.diff(found).min() > 20


def test_edge_cases(spark):
    nan = float("nan")
    rows = [("flat", 100.0, [1.0] * 500), ("none", 100.0, None), ("short", 100.0, [1.0, 2.0] * 20), ("rate", None, [1.0, 2.0] * 300), ("missing", 100.0, [None, nan] * 300), ("zero", 0.0, [1.0, 2.0] * 300)]
    df = spark.createDataFrame(rows, "k string, fs double, x array<double>")
    assert beat_votes(df, ["k"], "x", "fs").collect() == []
    assert voted_beats(df.limit(0), ["k"], "x", "fs").collect() == []
    x, truth = channel(100.0, 70, 20, 3)
    holes = [None if i % 97 == 5 else float(v) for i, v in enumerate(x)]
    clash = spark.createDataFrame([(None, 100.0, holes, 1, 2)], "k string, fs double, x array<double>, idx int, weight int")
    found = voted_beats(clash, ["k"], "x", "fs").collect()
    assert abs(len(found) - len(truth)) <= 2 and all(r["k"] is None for r in found)


def test_single_detectors():
    x, truth = channel(250.0, 80, 30, 4)
    for found in energy_peaks(x, (0.2, 0.1)):
        assert score(found, truth, 8)[0] > 0.95
    band = x - np.convolve(x, np.ones(51) / 51, "same")
    assert score(two_level_peaks(band, 250.0), truth, 20)[0] > 0.95
