"""Beats of ECG channels by the vote of several detectors.

Channels are cut into overlapping chunks, so a detector that learns has up to half a minute before a chunk's own samples. All
detectors run over one chunk in its task and hand on their beats as weighted votes, a few rows a second; votes are joined in
Spark by channel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulseloom.functions import kernels
from pulseloom.functions.common import quoted
from pulseloom.operators.channels import CHUNK, boxcar, chunked, frame_mean
from pulseloom.operators.detect import weighted_vote

#: Weights of the detectors and the least sum of an accepted beat: fixed values.
ENERGY_WEIGHTS = {0.2: 0.75, 0.1: 0.25, 0.4: 0.25}
LEVELS_WEIGHT, ADAPTIVE_WEIGHT, SQUARE_WEIGHT = 1.25, 1.5, 0.75
LEAST_VOTES = 2.4
LEARN_SEC, AHEAD_SEC = 30, 5


def energy_peaks(x: np.ndarray, shares: tuple[float, ...], integrate: int = 7) -> list[np.ndarray]:
    """For each share: the largest sample of every region whose slope energy exceeds that share of the channel's largest.

    The energy is the squared step summed over ``integrate`` samples, smoothed; the largest is that of the middle half.
    """
    step = np.diff(x, append=x[-1]) ** 2
    energy = boxcar(frame_mean(step, integrate // 2, integrate // 2) * integrate, 5, 1)
    largest = energy[len(x) // 4 : max(len(x) - len(x) // 4, len(x) // 4 + 1)].max()
    found = []
    for share in shares:
        on = energy > share * largest
        edges = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(int), [0]])))
        found.append(np.array([a + int(np.argmax(x[a:b])) for a, b in zip(edges[::2], edges[1::2], strict=True)], np.int64))
    return found


def peaks_of(y: np.ndarray, least: float, distance: float) -> np.ndarray:
    """Local maxima of ``y`` over ``least``, tallest first, at least ``distance`` apart."""
    at = np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] >= y[2:]) & (y[1:-1] > least)) + 1
    return at[kernels.tallest_first(at, y[at], distance)] if len(at) else at


def two_level_peaks(band: np.ndarray, fs: float) -> np.ndarray:
    """Beats of a band-passed channel by a signal and a noise level that follow the peaks of its energy.

    A peak is a beat above a quarter of the way from noise to signal. Where none came for 1.66 mean intervals the tallest peak
    over half of that is taken after all; a peak within 0.36 s of a beat and with under half of its slope is a T wave; after an
    interval outside 0.92..1.16 of the mean the level is halved.
    """
    slope = np.gradient(band)
    energy = frame_mean(slope**2, int(0.075 * fs), int(0.075 * fs))
    at = peaks_of(energy, 0.0, 0.2 * fs)
    if not len(at):
        return at
    height, reach = energy[at], max(1, int(0.075 * fs))
    steep = np.array([np.abs(slope[max(0, t - reach) : t + reach + 1]).max() for t in at])
    begin = energy[: max(1, int(2 * fs))]
    signal, noise = begin.max() / 3, begin.mean() / 2
    beats: list[int] = []
    for i, (t, h) in enumerate(zip(at, height, strict=True)):
        gaps = np.diff(at[beats[-9:]])
        mean = gaps.mean() if len(gaps) else 0.0
        level = noise + 0.25 * (signal - noise)
        if len(gaps) > 1 and not 0.92 * mean <= gaps[-1] <= 1.16 * mean:
            level /= 2
        if beats and mean and t - at[beats[-1]] > 1.66 * mean:
            missed = [k for k in range(beats[-1] + 1, i) if height[k] > level / 2]
            if missed:
                k = max(missed, key=lambda k: height[k])
                beats.append(k)
                signal = 0.25 * height[k] + 0.75 * signal
        wave = bool(beats) and t - at[beats[-1]] < 0.36 * fs and steep[i] < 0.5 * steep[beats[-1]]
        if h > level and not wave:
            beats.append(i)
            signal = 0.125 * h + 0.875 * signal
        else:
            noise = 0.125 * h + 0.875 * noise
    size = np.abs(band)
    return np.array([max(0, t - reach) + int(np.argmax(size[max(0, t - reach) : t + reach + 1])) for t in at[beats]], np.int64)


def snapped(at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Move each beat to the largest sample within a sixth of the median interval, the earliest of equals."""
    if len(at) < 2:
        return at
    reach = max(1, int(np.median(np.diff(np.sort(at))) / 6))
    return np.unique([max(0, t - reach) + int(np.argmax(x[max(0, t - reach) : t + reach + 1])) for t in at])


def _varies(x: np.ndarray) -> bool:
    known = x[np.isfinite(x)]
    return len(known) > 1 and known.max() > known.min()


def beat_votes(df: DataFrame, ids: list[str], samples: str, rate: str, *, size: int = CHUNK) -> DataFrame:
    """Votes (ids, idx, weight, height) of all detectors for the beats of array channels; height is the sample there.

    Null arrays, channels under two seconds or without any variation and null or non-positive rates have no votes; missing
    samples are held. Ids should be unique: equal ones vote together.
    """
    fs = quoted(rate).cast("double")
    rows = df.where((fs > 0) & (F.size(quoted(samples)) > fs * 2)).select(*map(quoted, ids), fs.alias("__rate"), quoted(samples).alias("__x"))
    chunks = chunked(rows, "__x", F.ceil(F.col("__rate") * LEARN_SEC), F.ceil(F.col("__rate") * AHEAD_SEC), size=size)
    schema = T.StructType([*rows.select(*map(quoted, ids)).schema.fields, T.StructField("idx", T.LongType()), T.StructField("weight", T.DoubleType()), T.StructField("height", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def votes_of(x: np.ndarray, band: np.ndarray, adaptive: np.ndarray, fs: float) -> Iterator[tuple[np.ndarray, float]]:
        regions = energy_peaks(x, tuple(ENERGY_WEIGHTS))
        levels = two_level_peaks(band, fs)
        gaps = [np.median(np.diff(a)) for a in (*regions, levels, adaptive) if len(a) > 1]
        centred = (x - x.mean()) ** 2
        squares = peaks_of(centred, centred.mean() + 2 * centred.std(), (np.median(gaps) if gaps else fs) / 2)
        for at, weight in zip(regions, ENERGY_WEIGHTS.values(), strict=True):
            yield at, weight
        for at, weight in ((levels, LEVELS_WEIGHT), (adaptive, ADAPTIVE_WEIGHT), (squares, SQUARE_WEIGHT)):
            yield snapped(at, x), weight

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rates, begin, lead, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__rate", "__at", "__lead", "__own"))
            for fs in np.unique(rates):
                alike = np.flatnonzero(rates == fs)
                for start in range(0, len(alike), 128):
                    some = alike[start : start + 128]
                    known = [np.asarray(batch.column("__x")[int(i)].values.to_numpy(zero_copy_only=False), float) for i in some]
                    varies = [k for k, x in enumerate(known) if _varies(x)]
                    some, known = some[varies], [known[k] for k in varies]
                    if not varies:
                        continue
                    matrix = kernels.padded(known)
                    row, at = kernels.adaptive_beats(matrix, fs, 5.0, 12.0, 0.175, 0.25, 1.5)
                    whole = kernels.held(matrix)
                    band = kernels.zero_phase(whole, kernels.butterworth(3, (5.0, min(15.0, 0.45 * fs)), fs, "band"))
                    for k, (i, x) in enumerate(zip(some, known, strict=True)):
                        n = len(x)
                        for found, weight in votes_of(whole[k, :n], band[k, :n], np.sort(at[row == k]), fs):
                            found = found[(found >= lead[i]) & (found < lead[i] + own[i])]
                            if len(found):
                                owner = pa.array(np.full(len(found), i))
                                columns = [pa.array(found + (begin[i] - lead[i]), pa.int64()), pa.array(np.full(len(found), weight)), pa.array(whole[k, found])]
                                yield pa.record_batch([*(batch.column(c).take(owner) for c in ids), *columns], schema=arrow)

    return chunks.mapInArrow(run, schema)


def voted_beats(df: DataFrame, ids: list[str], samples: str, rate: str, *, reach: int = 2, least: float = LEAST_VOTES, size: int = CHUNK) -> DataFrame:
    """Beats (ids, idx, height, votes) on which the detectors agree by weight; votes at most ``reach`` samples apart are one beat.

    A beat stands at its tallest sample. Cases as in :func:`beat_votes`.
    """
    return weighted_vote(beat_votes(df, ids, samples, rate, size=size), ids, "idx", "weight", "height", reach=reach, least=least)
