"""Numeric helpers against plain definitions."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulseloom.functions import kernels as K
from pulseloom.operators.moving import polynomial_weights


def test_butterworth_gains():
    for kind, cut, low_pass in (("low", 10.0, True), ("high", 10.0, False)):
        for order in (2, 3, 4):
            sections = K.butterworth(order, cut, 100.0, kind)

            def gain(hz):
                z = np.exp(-2j * np.pi * hz / 100.0)
                out = 1.0
                for b0, b1, b2, a1, a2 in sections:
                    out *= (b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)
                return abs(out)

            assert gain(10.0) == pytest.approx(np.sqrt(0.5), rel=1e-6)
            assert gain(0.001 if low_pass else 49.99) == pytest.approx(1.0, abs=1e-4)
            assert gain(45.0 if low_pass else 0.5) < 0.01


def test_band_pass_gains():
    sections = K.butterworth(3, (5.0, 15.0), 256.0, "band")

    def gain(hz):
        z = np.exp(-2j * np.pi * hz / 256.0)
        out = 1.0
        for b0, b1, b2, a1, a2 in sections:
            out *= (b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)
        return abs(out)

    assert gain(5.0) == pytest.approx(np.sqrt(0.5), rel=1e-3) and gain(15.0) == pytest.approx(np.sqrt(0.5), rel=1e-3)
    assert gain(8.7) == pytest.approx(1.0, abs=1e-3) and gain(0.5) < 0.01 and gain(100.0) < 0.01


def test_zero_phase_keeps_a_slow_wave_in_place():
    t = np.arange(1000) / 100.0
    slow, fast = np.sin(2 * np.pi * 0.5 * t), np.sin(2 * np.pi * 30 * t)
    out = K.zero_phase((slow + fast)[None], K.butterworth(3, 5.0, 100.0, "low"))[0]
    assert np.abs(out - slow)[50:-50].max() < 0.01


def test_trend_is_removed_and_waves_are_kept():
    t = np.arange(4000) / 100
    slow, wave = 3 * t - 0.05 * t**2, np.sin(2 * np.pi * 2 * t)
    out = K.without_trend((slow + wave)[None], 100.0, np.asarray(polynomial_weights(3, 401)))[0]
    middle = slice(600, -600)
    assert np.abs(out - out.mean() - wave)[middle].max() < 0.05
    assert abs(out.mean() - (slow + wave).mean()) < 0.1


def brute_warp(a, b):
    best = np.full((len(a) + 1, len(b) + 1), np.inf)
    best[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1, j + 1] = abs(a[i] - b[j]) + min(best[i, j], best[i, j + 1], best[i + 1, j])
    return best[-1, -1]


def brute_frechet(a, b):
    memo = {}

    def c(i, j):
        if (i, j) not in memo:
            d = abs(a[i] - b[j])
            before = [c(x, y) for x, y in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if x >= 0 and y >= 0]
            memo[i, j] = max(d, min(before)) if before else d
        return memo[i, j]

    return c(len(a) - 1, len(b) - 1)


def test_distances_equal_plain_recursions():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(20, 9)), rng.normal(size=(20, 7))
    assert np.allclose(K.warp_distance(a, b), [brute_warp(x, y) for x, y in zip(a, b)])
    assert np.allclose(K.frechet_distance(a, b), [brute_frechet(x, y) for x, y in zip(a, b)])
    assert K.warp_distance(a, a).max() == 0 and K.frechet_distance(a, a).max() == 0


def test_distance_profile_equals_plain_definition():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=300).cumsum(), rng.normal(size=20)
    x[100:130] = 5.0
    got = K.distance_profile(x, q)
    z = lambda v: (v - v.mean()) / v.std()
    for i in range(len(x) - 19):
        part = x[i : i + 20]
        if part.std() < 1e-9:
            assert np.isnan(got[i])
        else:
            assert got[i] == pytest.approx(np.linalg.norm(z(part) - z(q)), abs=1e-5)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(0, 9)), min_size=1, max_size=40, unique_by=lambda p: p[0]), st.integers(1, 30))
def test_thinned_peaks_are_apart_and_none_is_missing(peaks, distance):
    peaks.sort()
    position, height = np.array([p for p, _ in peaks]), np.array([h for _, h in peaks], float)
    kept = K.tallest_first(position, height, distance)
    chosen = position[kept]
    assert (np.diff(chosen) >= distance).all()
    for p, h in peaks:  # every dropped peak is near a kept one that is at least as tall
        assert any(abs(p - position[k]) < distance and height[k] >= h for k in kept) or p in chosen


def test_t_quantiles():
    for p, dof, value in ((0.975, 10, 2.228139), (0.95, 1, 6.313752), (0.995, 30, 2.749996), (0.5, 5, 0.0), (0.025, 10, -2.228139)):
        assert K.t_quantile(p, dof) == pytest.approx(value, abs=1e-5)


def test_extreme_deviates_of_a_published_example():
    # Rosner's data, as in the NIST handbook: three outliers
    x = np.array([-0.25, 0.68, 0.94, 1.15, 1.20, 1.26, 1.26, 1.34, 1.38, 1.43, 1.49, 1.49, 1.55, 1.56, 1.58, 1.65, 1.69, 1.70, 1.76, 1.77, 1.81, 1.91, 1.94, 1.96, 1.99, 2.06, 2.09, 2.10, 2.14, 2.15, 2.23, 2.24, 2.26, 2.35, 2.37, 2.40, 2.47, 2.54, 2.62, 2.64, 2.90, 2.92, 2.92, 2.93, 3.21, 3.26, 3.30, 3.59, 3.68, 4.30, 4.64, 5.34, 5.42, 6.01])
    assert sorted(x[K.extreme_deviates(x, 10)]) == [5.34, 5.42, 6.01]
    assert not K.extreme_deviates(np.array([1.0, np.nan]), 2).any() and not K.extreme_deviates(np.ones(9), 3).any()


def test_polynomial_weights_reproduce_polynomials():
    x = np.arange(-5, 6)
    y = 2 + 3 * x - x**2 + 0.5 * x**3
    assert np.dot(polynomial_weights(3, 11), y) == pytest.approx(2)
    assert np.dot(polynomial_weights(3, 11, 1), y) == pytest.approx(3)


def synthetic_ecg(fs, seconds, bpm, seed):
    rng = np.random.default_rng(seed)
    x, beats, t = rng.normal(0, 0.02, int(fs * seconds)), [], 0.7
    grid = np.arange(len(x)) / fs
    while t < seconds - 0.5:
        beats.append(t)
        for shift, size, width in ((0, 1.2, 0.012), (-0.03, -0.2, 0.01), (0.03, -0.3, 0.012), (0.28, 0.25, 0.05), (-0.17, 0.1, 0.03)):
            x += size * np.exp(-((grid - t - shift) ** 2) / (2 * width**2))
        t += 60 / bpm * (1 + rng.normal(0, 0.04))
    return x + 0.3 * np.sin(2 * np.pi * 0.2 * grid), np.array(beats)


@pytest.mark.parametrize("fs", [125.0, 256.0, 500.0])
@pytest.mark.parametrize("bpm", [50, 75, 130])
def test_adaptive_beats_on_synthetic_channels(fs, bpm):
    both = [synthetic_ecg(fs, 20, bpm, seed) for seed in (1, 2)]
    row, at = K.adaptive_beats(K.padded([x for x, _ in both]), fs, 5, 15, 0.15, 0.25, 1.5)
    for k, (_, beats) in enumerate(both):
        found = at[row == k] / fs
        near = np.abs(found[:, None] - beats).min(1)
        missed = np.abs(beats[:, None] - found).min(1) > 0.05
        assert (near > 0.05).sum() <= 1 and missed.sum() <= 1
