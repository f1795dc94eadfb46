"""Small numeric helpers that run inside tasks, on one Arrow batch of channels or waves at a time."""

from __future__ import annotations

import numpy as np


def padded(rows: list[np.ndarray]) -> np.ndarray:
    """Rows of unequal length as a matrix, padded with NaN."""
    out = np.full((len(rows), max(map(len, rows), default=0)), np.nan)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def tallest_first(position: np.ndarray, height: np.ndarray, distance: float) -> np.ndarray:
    """Indices, by position, of the peaks kept when each, from the tallest, removes those nearer than ``distance``."""
    alive, kept = np.ones(len(position), bool), []
    for i in np.lexsort((position, -height)):
        if alive[i]:
            kept.append(i)
            alive &= np.abs(position - position[i]) >= distance
    return np.array(sorted(kept, key=lambda i: position[i]), np.int64)


def held(x: np.ndarray) -> np.ndarray:
    """Missing samples take the last present one before them in their row, else the row's first present one, else 0."""
    there = np.isfinite(x)
    at = np.maximum.accumulate(np.where(there, np.arange(x.shape[1]), -1), axis=1)
    first = np.argmax(there, axis=1)[:, None]
    out = np.take_along_axis(x, np.where(at < 0, first, at), axis=1)
    return np.where(np.isfinite(out), out, 0.0)


def butterworth(order: int, cutoff: float | tuple[float, float], fs: float, kind: str = "low") -> list[np.ndarray]:
    """Second-order sections (b0, b1, b2, a1, a2) of a Butterworth low-, high- or band-pass by the bilinear transform."""
    warp = lambda hz: 2 * fs * np.tan(np.pi * hz / fs)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if kind == "band":
        low, high = warp(cutoff[0]), warp(cutoff[1])
        half, centre = poles * (high - low) / 2, low * high
        poles = np.concatenate([half + np.sqrt(half**2 - centre), half - np.sqrt(half**2 - centre)])
        reference = np.sqrt(centre)
    else:
        edge = warp(cutoff)
        poles = poles * edge if kind == "low" else edge / poles
        reference = 0.0 if kind == "low" else np.inf
    zp = (2 * fs + poles) / (2 * fs - poles)
    upper, real = zp[zp.imag > 1e-12], np.sort(zp[np.abs(zp.imag) <= 1e-12].real)
    pairs = [np.array([p, p.conj()]) for p in upper] + [real[k : k + 2].astype(complex) for k in range(0, len(real), 2)]
    point = np.exp(2j * np.arctan(reference / (2 * fs))) if np.isfinite(reference) else -1.0
    sections = []
    for pair in pairs:
        ends = {"low": [-1.0, -1.0], "high": [1.0, 1.0], "band": [1.0, -1.0]}[kind][: len(pair)]
        b, a = (np.pad(np.real(np.poly(r)), (0, 2 - len(pair))) for r in (ends, pair))
        powers = point ** -np.arange(3)
        gain = abs((a * powers).sum() / (b * powers).sum())
        sections.append(np.concatenate([b * gain, a[1:]]))
    return sections


def _pass(x: np.ndarray, sections: list[np.ndarray]) -> np.ndarray:
    """Run sections over axis 1 of all rows at once, starting in the steady state of each row's first sample."""
    y = np.ascontiguousarray(x.T)
    for b0, b1, b2, a1, a2 in sections:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        first = y[0]
        s2 = (b2 - a2 * gain) * first
        s1 = (b1 - a1 * gain) * first + s2
        out = np.empty_like(y)
        for t in range(len(y)):
            v = y[t]
            w = b0 * v + s1
            s1 = b1 * v - a1 * w + s2
            s2 = b2 * v - a2 * w
            out[t] = w
        y = out
    return y.T


def zero_phase(x: np.ndarray, sections: list[np.ndarray]) -> np.ndarray:
    """Filter rows forwards and backwards, with odd reflections at both ends."""
    edge = min(3 * (2 * len(sections) + 1), x.shape[1] - 1)
    front, back = 2 * x[:, :1] - x[:, edge:0:-1], 2 * x[:, -1:] - x[:, -2 : -edge - 2 : -1]
    y = _pass(np.concatenate([front, x, back], axis=1), sections)
    y = _pass(y[:, ::-1], sections)[:, ::-1]
    return y[:, edge : edge + x.shape[1]]


def without_trend(x: np.ndarray, fs: float, weights: np.ndarray) -> np.ndarray:
    """Rows minus their trend, about their own mean: a polynomial smooth by ``weights``, averaged over a second.

    Both ends are continued by odd reflection.
    """
    second = max(1, int(round(fs)))
    edge = min(len(weights) // 2 + second, x.shape[1] - 1)
    longer = np.concatenate([2 * x[:, :1] - x[:, edge:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -edge - 2 : -1]], axis=1)
    kernel = np.convolve(weights[::-1], np.full(second, 1 / second))
    trend = np.stack([np.convolve(row, kernel, "same") for row in longer])[:, edge : edge + x.shape[1]]
    return x - trend + x.mean(axis=1, keepdims=True)


def adaptive_beats(x: np.ndarray, fs: float, low_hz: float, high_hz: float, window_sec: float, refractory_sec: float, decay_sec: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of the beats of all rows; see ``operators.detect.detect_beats``."""
    length = np.where(np.isfinite(x), np.arange(1, x.shape[1] + 1), 0).max(axis=1)
    band = zero_phase(held(x), butterworth(3, (low_hz, min(high_hz, 0.45 * fs)), fs, "band"))
    energy = np.gradient(band, axis=1) ** 2
    width = max(1, int(round(window_sec * fs)))
    total = np.cumsum(np.pad(energy, ((0, 0), (width, 0))), axis=1)
    level_in = (total[:, width:] - total[:, :-width]) / width
    start = np.median(np.sort(level_in, axis=1)[:, -max(1, x.shape[1] // 20) :], axis=1)
    decay, rest = 0.5 ** (1 / (decay_sec * fs)), int(round(refractory_sec * fs))
    level, floor = start.copy(), 0.15 * start
    quiet = np.zeros(len(x), np.int64)
    above = np.zeros(len(x), bool)
    began = np.zeros(len(x), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, int]] = []
    for t in range(x.shape[1]):
        v = level_in[:, t]
        on = v > 0.35 * level
        opens = on & ~above & (quiet <= 0) & (t < length)
        closes = above & ~on
        began = np.where(opens, t, began)
        if closes.any():
            rows = np.flatnonzero(closes)
            found.append((rows, began[rows], t))
            quiet = np.where(closes, rest - (t - began), quiet)
        above = np.where(opens, True, above & on)
        level = np.where(above, np.maximum(level, 0.5 * level + 0.5 * v), np.maximum(level * decay, floor))
        quiet -= 1
    rows_out, at_out = [], []
    size = np.abs(band)
    for rows, low, high in found:
        for r, a in zip(rows, low, strict=True):
            a = max(0, a - width // 2)
            rows_out.append(r)
            at_out.append(a + int(np.argmax(size[r, a:high])))
    return np.array(rows_out, np.int64), np.array(at_out, np.int64)


def warp_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dynamic time warping distance of each row of ``a`` to the same row of ``b``: least sum of absolute differences."""
    best = np.full((len(a), b.shape[1] + 1), np.inf)
    best[:, 0] = 0
    for i in range(a.shape[1]):
        cost = np.abs(a[:, i : i + 1] - b)
        row = np.full_like(best, np.inf)
        for j in range(b.shape[1]):
            row[:, j + 1] = cost[:, j] + np.minimum(np.minimum(best[:, j], best[:, j + 1]), row[:, j])
        best = row
    return best[:, -1]


def frechet_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Discrete Frechet distance of each row of ``a`` to the same row of ``b``, over the values."""
    best = None
    for i in range(a.shape[1]):
        cost = np.abs(a[:, i : i + 1] - b)
        row = np.empty_like(cost)
        for j in range(b.shape[1]):
            before = [] if best is None else ([best[:, j]] + ([best[:, j - 1]] if j else []))
            before += [row[:, j - 1]] if j else []
            row[:, j] = np.maximum(cost[:, j], np.minimum.reduce(before)) if before else cost[:, j]
        best = row
    return best[:, -1]


def distance_profile(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """z-normalised Euclidean distance of ``query`` to every stretch of its length in ``x``; NaN where one is flat."""
    m = len(query)
    if len(x) < m:
        return np.zeros(0)
    size = 1 << int(np.ceil(np.log2(len(x) + m)))
    dots = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(query[::-1], size), size)[m - 1 : len(x)]
    one, two = np.cumsum(np.insert(x, 0, 0)), np.cumsum(np.insert(x * x, 0, 0))
    mean = (one[m:] - one[:-m]) / m
    std = np.sqrt(np.maximum((two[m:] - two[:-m]) / m - mean**2, 0))
    flat = std * query.std() < 1e-9
    corr = (dots - m * mean * query.mean()) / np.where(flat, 1, m * std * query.std())
    return np.where(flat, np.nan, np.sqrt(np.maximum(2 * m * (1 - corr), 0)))


def resampled(rows: np.ndarray, n: int) -> np.ndarray:
    """Rows on ``n`` evenly spaced points by linear interpolation."""
    at = np.linspace(0, rows.shape[1] - 1, n)
    low = np.minimum(at.astype(int), max(0, rows.shape[1] - 2))
    part = at - low
    high = np.minimum(low + 1, rows.shape[1] - 1)
    return rows[:, low] * (1 - part) + rows[:, high] * part


def t_quantile(p: float, dof: float) -> float:
    """Quantile of Student's t by bisection of its distribution, integrated numerically."""
    from math import exp, lgamma, pi, sqrt

    scale = exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(dof * pi)
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1 - p, dof)
    nodes, weights = np.polynomial.legendre.leggauss(80)

    def upper(t: float) -> float:  # with u = atan(x / sqrt(dof)) the density is a power of a cosine
        a, b = np.arctan(t / sqrt(dof)), pi / 2
        u = (b - a) / 2 * nodes + (a + b) / 2
        return float((b - a) / 2 * (weights * scale * sqrt(dof) * np.cos(u) ** (dof - 1)).sum())

    low, high = 0.0, 1.0
    while upper(high) > 1 - p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if upper(middle) > 1 - p else (low, middle)
    return (low + high) / 2


def extreme_deviates(x: np.ndarray, most: int, alpha: float = 0.05) -> np.ndarray:
    """Mask of the outliers of one sample by the generalised extreme studentised deviate test; NaN is none."""
    mask, alive = np.zeros(len(x), bool), np.flatnonzero(np.isfinite(x))
    n, removed, last = len(alive), [], 0
    for i in range(1, min(most, n - 2) + 1):
        values = x[alive]
        spread = values.std(ddof=1)
        if not spread > 0:
            break
        far = np.abs(values - values.mean())
        k = int(np.argmax(far))
        t = t_quantile(1 - alpha / (2 * (n - i + 1)), n - i - 1)
        removed.append(alive[k])
        if far[k] / spread > (n - i) * t / np.sqrt((n - i - 1 + t * t) * (n - i + 1)):
            last = i
        alive = np.delete(alive, k)
    mask[removed[:last]] = True
    return mask


def smooth_row(y: np.ndarray, width: int, passes: int = 3) -> np.ndarray:
    """Boxcar smoothing of one channel as in ``moving.smooth``; NaN where the samples there weigh less than half the width."""
    if width < 2:
        return y
    weights = np.ones(width) if width % 2 else np.r_[0.5, np.ones(width - 1), 0.5]
    half = len(weights) // 2
    for _ in range(passes):
        known = ~np.isnan(y)
        total, weight = (np.convolve(x, weights)[half : half + len(y)] for x in (np.where(known, y, 0.0), known.astype(float)))
        y = np.where(weight >= max(width / 2, 1), total / np.where(weight > 0, weight, 1), np.nan)
    return y


def second_valley(y: np.ndarray) -> int | None:
    """Position of the least sample between the first two peaks of the channel smoothed over a tenth of its length, or None."""
    smoothed = smooth_row(y, int(len(y) / 10 + 0.5))
    starts = np.flatnonzero(np.r_[True, smoothed[1:] != smoothed[:-1]]) if len(y) else np.zeros(0, int)  # level peaks count where they begin
    levels = smoothed[starts]
    peaks = starts[1:-1][(levels[1:-1] > levels[:-2]) & (levels[1:-1] > levels[2:])]
    if len(peaks) < 2 or np.isnan(y[peaks[0] : peaks[1] + 1]).all():
        return None
    return int(peaks[0] + np.nanargmin(y[peaks[0] : peaks[1] + 1]))
