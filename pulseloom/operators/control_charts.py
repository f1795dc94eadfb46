"""Implausible readings of sampled channels, flagged against what is usual for the very channel.

A robust exponentially weighted control chart follows the steps between a channel's readings: its mean and scale are
updated with values that are clipped at the control limits first, so a spike cannot widen the limits that should catch
it. A second chart of the same kind follows the height from trough to peak. Spikes are taken from the readings whose
steps break the limits and then checked against that height; run-length counters find held values, and physical
limits impossible ones. All channels of an Arrow batch are charted together, one vector operation for each step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulseloom.functions.common import quoted

#: Readings that are handled together; longer channels are cut into overlapping pieces.
PIECE = 65_536
#: Seconds of overlap, many times the memory of the charts.
OVERLAP_SEC = 8.0
#: Channels that are charted in one matrix.
TOGETHER = 256
IMPOSSIBLE, HELD, SPIKE = "impossible", "held", "spike"


def clipped_chart(x: np.ndarray, use: np.ndarray, weight: float, limit: float, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Robust EW chart along axis 1 for all rows at once: (beyond the limits?, level after each step).

    ``use`` masks values that are there; ``mean`` and ``scale`` are the rows' starting values.
    """
    beyond, level = np.zeros(x.shape, bool), np.empty(x.shape)
    mean, scale = mean.astype(float).copy(), scale.astype(float).copy()
    columns, masks = np.ascontiguousarray(x.T), np.ascontiguousarray(use.T)
    for t in range(x.shape[1]):
        off, on = columns[t] - mean, masks[t]
        bound = limit * scale
        inside = np.clip(off, -bound, bound)
        beyond[:, t] = (inside != off) & on
        step = np.where(on, inside, 0.0)
        scale += weight * np.where(on, np.abs(step) - scale, 0.0)
        mean += weight * step
        level[:, t] = mean
    return beyond, level


def _runs(x: np.ndarray) -> np.ndarray:
    """How many equal neighbours the run holds that each value belongs to (NaN: 1)."""
    n = x.shape[1]
    at = np.arange(n)
    changed = np.ones(x.shape, bool)
    changed[:, 1:] = x[:, 1:] != x[:, :-1]
    start = np.maximum.accumulate(np.where(changed, at, 0), axis=1)
    last = np.ones(x.shape, bool)
    last[:, :-1] = changed[:, 1:]
    end = np.minimum.accumulate(np.where(last, at, n)[:, ::-1], axis=1)[:, ::-1]
    return end - start + 1


def window_heights(x: np.ndarray, use: np.ndarray, width: int) -> np.ndarray:
    """Trough-to-peak height of each row's windows; NaN where less than half of a window is there."""
    k = x.shape[1] // width
    cube, there = (a[:, : k * width].reshape(len(x), k, width) for a in (x, use))
    tall = np.where(there, cube, -np.inf).max(2) - np.where(there, cube, np.inf).min(2)
    return np.where(there.sum(2) > width // 2, tall, np.nan)


def usual_height(heights: np.ndarray) -> np.ndarray:
    """Usual height of each row from a chart over its windows' heights; NaN where there is no window."""
    there = np.isfinite(heights)
    usual = np.full(len(heights), np.nan)
    rows = np.flatnonzero(there.any(1))
    if len(rows):
        tall, there = heights[rows], there[rows]
        middle = np.nanmedian(tall, axis=1)
        spread = np.nanmedian(np.abs(tall - middle[:, None]), axis=1)
        _, level = clipped_chart(np.where(there, tall, 0), there, 0.1, 2.0, middle, np.maximum(spread, 1e-3 * middle))
        usual[rows] = np.median(level, axis=1)
    return usual


def stand_out(values: np.ndarray, broke: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Runs of one to three readings between two steps that broke the limits: (their positions, how far they stand out).

    The distance is that of the run's nearest reading from the nearer of the readings before and after, on one side.
    """
    out = []
    for n in (1, 2, 3):
        i = np.flatnonzero(broke[1:-n] & broke[1 + n :]) + 1 if len(values) > n + 1 else np.zeros(0, int)
        if len(i):
            at = i[:, None] + np.arange(n)
            run, a, b = values[at], values[i - 1], values[i + n]
            out.append((at, np.maximum(run.min(1) - np.maximum(a, b), np.minimum(a, b) - run.max(1))))
    return out


def flag_matrix(x: np.ndarray, rate: np.ndarray, spike_factor: np.ndarray, *, physical_limit: float, held_sec: float, window_sec: float, weight: float, limit: float) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """(rows, positions, kind) of the implausible readings of padded channels; NaN is no reading."""
    there = ~np.isnan(x)
    impossible = there & ~(np.abs(x) <= physical_limit)
    valid = there & ~impossible
    out = [(*np.nonzero(impossible), IMPOSSIBLE)]
    held = there & (_runs(x) >= np.maximum(2, np.ceil(held_sec * rate - 1e-9))[:, None])
    out.append((*np.nonzero(held), HELD))

    position = np.maximum.accumulate(np.where(valid, np.arange(x.shape[1]), 0), axis=1)
    filled = np.where(valid, x, 0)[np.arange(len(x))[:, None], position]
    step = np.zeros(x.shape)
    step[:, 1:] = np.diff(filled, axis=1)
    step = np.where(valid, step, 0)
    first = np.argmax(valid, axis=1)
    step[np.arange(len(x)), first] = 0
    moving = np.where(valid & (step != 0), np.abs(step), np.nan)
    some = np.isfinite(moving).any(1)
    scale = np.zeros(len(x))
    if some.any():
        scale[some] = np.nanmedian(moving[some], axis=1)
    beyond, _ = clipped_chart(step, valid, weight, limit, np.zeros(len(x)), scale)
    for fs in np.unique(rate):
        rows = np.flatnonzero(rate == fs)
        width = max(2, int(round(window_sec * fs)))
        use = valid[rows]
        first = window_heights(x[rows], use, width)
        runs = {}
        for k, row in enumerate(rows):
            tall = first[k][first[k] > 0]
            if not len(tall) or not beyond[row].any():
                continue
            at = np.flatnonzero(valid[row])
            runs[k] = (at, stand_out(x[row, at], beyond[row, at]))
            # readings that stand out much are left out of the heights, so that many spikes don't raise what is usual
            much = 0.5 * spike_factor[row] * np.quantile(tall, 0.25)
            for places, far in runs[k][1]:
                use[k, at[places[far >= much]]] = False
        usual = usual_height(window_heights(x[rows], use, width)) if runs else np.zeros(len(rows))
        for k, (at, found) in runs.items():
            marked = np.zeros(len(at), bool)
            for places, far in found:
                if usual[k] > 0:
                    marked[places[far >= spike_factor[rows[k]] * usual[k]].ravel()] = True
            out.append((np.full(marked.sum(), rows[k]), at[marked], SPIKE))
    return out


def flag_implausible(
    df: DataFrame,
    ids: list[str],
    samples: str,
    rate: str,
    spike_factor: str,
    *,
    physical_limit: float = 1000.0,
    held_sec: float = 0.2,
    window_sec: float = 1.6,
    weight: float = 0.02,
    limit: float = 5.0,
) -> DataFrame:
    """Rows (ids, idx, kind) of implausible readings in the array column ``samples``, one row for each kind of a reading.

    :param rate: column with the sampling rate. :param spike_factor: column with the least excess of a spike, in
        usual trough-to-peak heights. :param weight, limit: memory of the charts and their control limits in scales.

    Defined cases: null arrays, arrays of fewer than two samples (an absent channel), null or non-positive rates: no
    rows; null and NaN readings are none and are skipped between a spike and its neighbours; infinite readings are
    impossible; a channel without any variation has held values but no spikes; repeated rows are flagged each; null
    ids are kept; other columns are ignored. Channels longer than ``PIECE`` are cut into pieces that overlap.
    """
    names = [f"id{i}" for i in range(len(ids))]
    one = df.select(*(quoted(c).alias(a) for c, a in zip(ids, names, strict=True)), quoted(samples).alias("x"), quoted(rate).cast("double").alias("rate"), quoted(spike_factor).cast("double").alias("factor"))
    one = one.where((F.size("x") > 1) & (F.col("rate") > 0))
    margin = F.ceil(F.col("rate") * OVERLAP_SEC).cast("int")
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / PIECE).cast("int")))
    cut = one.withColumn("piece", piece).withColumn("low", F.greatest(F.col("piece") * PIECE - margin, F.lit(0)))
    cut = cut.withColumn("x", F.slice("x", F.col("low") + 1, F.lit(PIECE) + margin * 2))
    return _flags(cut, names, physical_limit, held_sec, window_sec, weight, limit).withColumnsRenamed(dict(zip(names, ids, strict=True)))


def _flags(cut: DataFrame, names: list[str], physical_limit: float, held_sec: float, window_sec: float, weight: float, limit: float) -> DataFrame:
    schema = T.StructType([*cut.select(*names).schema.fields, T.StructField("idx", T.LongType()), T.StructField("kind", T.StringType())])
    arrow = to_arrow_schema(schema)

    def part(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        arrays = batch.column("x")
        offsets, flat = arrays.offsets.to_numpy(), arrays.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
        rate, factor = batch.column("rate").to_numpy(), batch.column("factor").to_numpy(zero_copy_only=False)
        low, number = batch.column("low").to_numpy(), batch.column("piece").to_numpy()
        size = np.diff(offsets)
        places = None
        if "at" in batch.schema.names:  # positions of the readings, from the piece's first one
            places = batch.column("at").values.to_numpy()
            size = np.where(size > 0, places[np.maximum(offsets[1:] - 1, 0)] + 1, 0)
        order = np.argsort(size, kind="stable")  # channels of like length share a matrix
        start = 0
        while start < len(order):
            rows = order[start : start + TOGETHER]
            rows = rows[: max(1, int(4_000_000 // max(1, size[rows].max())))]
            start += len(rows)
            x = np.full((len(rows), int(size[rows].max())), np.nan)
            for k, r in enumerate(rows):
                own = slice(offsets[r], offsets[r + 1])
                x[k, slice(size[r]) if places is None else places[own]] = flat[own]
            found = flag_matrix(x, rate[rows], factor[rows], physical_limit=physical_limit, held_sec=held_sec, window_sec=window_sec, weight=weight, limit=limit)
            for at, position, kind in found:
                idx = position + low[rows[at]]
                own = idx // PIECE == number[rows[at]]
                at, idx = rows[at[own]], idx[own]
                if len(at):
                    yield pa.record_batch([*(batch.column(a).take(pa.array(at)) for a in names), pa.array(idx, pa.int64()), pa.array([kind] * len(at))], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from part(batch)

    return cut.mapInArrow(run, schema)


def flag_implausible_readings(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: str,
    *,
    rate: float,
    spike_factor: float,
    physical_limit: float = 1000.0,
    held_sec: float = 0.2,
    window_sec: float = 1.6,
    weight: float = 0.02,
    limit: float = 5.0,
) -> DataFrame:
    """:func:`flag_implausible` for a table with one reading a row; ``order`` is the reading's integer position.

    Readings are gathered by source and stretch of ``PIECE`` positions, with an overlap, so a busy source is many
    groups. Missing positions are missing readings. Of several readings at one position the largest counts; a null
    position is none.
    """
    names = [f"id{i}" for i in range(len(keys))]
    margin = int(np.ceil(rate * OVERLAP_SEC))
    at = quoted(order).cast("bigint")
    reading = df.where(at.isNotNull()).select(*(quoted(k).alias(a) for k, a in zip(keys, names, strict=True)), at.alias("at"), quoted(value).cast("double").alias("v"))
    pieces = F.array_distinct(F.array(*(F.floor((F.col("at") + d) / PIECE) for d in (-margin, 0, margin))))
    spread = reading.withColumn("piece", F.explode(pieces)).groupBy(*names, "piece", "at").agg(F.max("v").alias("v"))
    held = spread.groupBy(*names, "piece").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("r"))
    low = F.element_at("r", 1)["at"]
    cut = held.withColumns({"low": low, "x": F.transform("r", lambda r: r["v"]), "at": F.transform("r", lambda r: (r["at"] - low).cast("int"))})
    cut = cut.withColumns({"rate": F.lit(float(rate)), "factor": F.lit(float(spike_factor))}).select(*names, "x", "at", "rate", "factor", "piece", "low")
    return _flags(cut, names, physical_limit, held_sec, window_sec, weight, limit).withColumnsRenamed(dict(zip(names, keys, strict=True)))
