"""Peaks, regions and votes over signals, and labels of beat intervals."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulseloom.functions import kernels
from pulseloom.functions.common import join_summary, quoted
from pulseloom.operators.moving import _number, _total, framed, polynomial_weights, regularity, smooth_and_level, window_sum
from pulseloom.operators.runs import cluster_by_gap


def local_maxima(df: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """Samples above the one before and not below the one after; a channel's first and last sample are none."""

    def add(rows: DataFrame, _, order) -> DataFrame:
        v = _number(value)
        return rows.withColumn("__peak", (v > F.lag(v).over(order)) & (v >= F.lead(v).over(order)))

    return framed(df, keys, position, 1, 1, add).where("__peak").drop("__peak")


def tall_samples(df: DataFrame, keys: list[str], value: Column, deviations: float, out: str = "score") -> DataFrame:
    """Rows whose ``value`` exceeds the entity's mean by ``deviations`` sample standard deviations; adds it as ``out``."""
    scored = df.withColumn(out, value)
    stats = scored.groupBy(*map(quoted, keys)).agg((F.avg(out) + F.stddev_samp(out) * deviations).alias("__least"))
    return join_summary(scored, stats, keys).where(F.col(out) > F.col("__least")).drop("__least")


def thin_peaks(peaks: DataFrame, keys: list[str], position: str, height: str, distance: int) -> DataFrame:
    """Keep peaks tallest first, each removing those closer than ``distance``; equal heights: the earlier one.

    Peaks further apart than ``distance`` from all others are independent, so each chain of close peaks is a group.
    """
    w = Window.partitionBy(*map(quoted, keys)).orderBy(quoted(position))
    far = F.coalesce((quoted(position) - F.lag(quoted(position)).over(w) >= distance).cast("int"), F.lit(1))
    chained = peaks.withColumn("__far", far).withColumn("__chain", F.sum("__far").over(w)).drop("__far")
    schema = peaks.schema
    arrow = to_arrow_schema(schema)

    def keep(table: pa.Table) -> pa.Table:
        chosen = kernels.tallest_first(table[position].to_numpy(), table[height].to_numpy(), distance)
        return table.take(pa.array(chosen)).select(arrow.names).cast(arrow)

    single = F.count("*").over(Window.partitionBy(*map(quoted, keys), "__chain"))
    counted = chained.withColumn("__size", single)
    alone = counted.where("__size = 1").select(*map(quoted, peaks.columns))
    crowd = counted.where("__size > 1").groupBy(*map(quoted, keys), "__chain").applyInArrow(keep, schema)
    return alone.unionByName(crowd)


def snap_to_maximum(points: DataFrame, signal: DataFrame, keys: list[str], position: str, value: str, reach: int) -> DataFrame:
    """Move each point to the largest sample within ``reach`` positions; equal samples: the earliest. Adds ``snapped`` and its value.

    Points without a sample in reach are dropped; repeated points come out once.
    """
    cell = max(1, 2 * reach)
    at = quoted(position)
    own = points.select(*map(quoted, keys), at.alias("__at")).distinct()
    wide = own.withColumn("__cell", F.explode(F.array_distinct(F.array(F.floor((F.col("__at") - reach) / cell), F.floor((F.col("__at") + reach) / cell)))))
    near = wide.join(signal.select(*map(quoted, keys), at.alias("__pos"), _number(value).alias("__v"), F.floor(at / cell).alias("__cell")), [*keys, "__cell"])
    near = near.where((F.abs(F.col("__pos") - F.col("__at")) <= reach) & F.col("__v").isNotNull())
    best = near.groupBy(*map(quoted, keys), "__at").agg(F.max(F.struct(F.col("__v").alias("v"), (-F.col("__pos")).alias("p"))).alias("__best"))
    return best.select(*map(quoted, keys), F.col("__at").alias(position), (-F.col("__best.p")).alias("snapped"), F.col("__best.v").alias(value))


def weighted_vote(votes: DataFrame, keys: list[str], position: str, weight: str, height: str, *, reach: int, least: float) -> DataFrame:
    """Join votes at most ``reach`` apart into candidates and accept those whose weights add up to ``least``.

    A candidate stands at its tallest vote (the earliest of equals). Chains of close votes are one candidate.
    """
    w = Window.partitionBy(*map(quoted, keys)).orderBy(quoted(position))
    far = F.coalesce((quoted(position) - F.lag(quoted(position)).over(w) > reach).cast("int"), F.lit(1))
    numbered = votes.where(quoted(position).isNotNull()).withColumn("__far", far)
    numbered = numbered.withColumn("__no", F.sum("__far").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    agreed = numbered.groupBy(*map(quoted, keys), F.col("__no").alias("candidate")).agg(
        F.max(F.struct(quoted(height).alias("h"), (-quoted(position)).alias("p"))).alias("__top"), F.round(F.sum(quoted(weight)), 9).alias("votes")
    )
    return agreed.where(F.col("votes") >= least).select(*map(quoted, keys), (-F.col("__top.p")).alias(position), F.col("__top.h").alias(height), "votes")


def run_extrema(df: DataFrame, keys: list[str], position: str, value: str, mask: str) -> DataFrame:
    """One row per run of a boolean mask: the largest sample of a true run ("peak"), the smallest of a false one ("valley").

    Columns: keys, run_no, kind, position, value; equal samples: the earliest. Null masks are dropped.
    """
    rows = df.where(quoted(mask).isNotNull() & _number(value).isNotNull())
    w = Window.partitionBy(*map(quoted, keys)).orderBy(quoted(position))
    begins = F.coalesce((quoted(mask) != F.lag(quoted(mask)).over(w)).cast("int"), F.lit(1))
    numbered = rows.withColumn("__begins", begins).withColumn("run_no", F.sum("__begins").over(w))
    best = F.struct(F.when(quoted(mask), _number(value)).otherwise(-_number(value)).alias("v"), (-quoted(position)).alias("p"))
    top = numbered.groupBy(*map(quoted, keys), "run_no", quoted(mask).alias("__mask")).agg(F.max(best).alias("__top"))
    kind = F.when(F.col("__mask"), "peak").otherwise("valley")
    found = F.when(F.col("__mask"), F.col("__top.v")).otherwise(-F.col("__top.v"))
    return top.select(*map(quoted, keys), "run_no", kind.alias("kind"), (-F.col("__top.p")).alias(position), found.alias(value))


def pulse_valleys_and_peaks(df: DataFrame, keys: list[str], position: str, value: str, *, smooth_width: int, mean_width: int) -> DataFrame:
    """Valleys and peaks of a pulse wave: extrema of the runs below and above the moving mean of the smoothed signal."""
    own = df.select(*map(quoted, keys), quoted(position), quoted(value))
    level = smooth_and_level(own, keys, position, value, smooth_width=smooth_width, mean_width=mean_width)
    masked = level.withColumn("__above", F.col("smooth") > F.col("level"))
    return run_extrema(masked, keys, position, value, "__above")


def energy_regions(df: DataFrame, keys: list[str], position: str, value: str, *, integrate: int = 7, threshold: float = 0.2) -> DataFrame:
    """Regions of high slope energy and their largest sample: keys, region, low, high, position, value.

    The squared steps are summed over ``integrate`` positions; a region is where the sum exceeds ``threshold`` times
    its largest value of the entity.
    """

    def energy(rows: DataFrame, _, order) -> DataFrame:
        step = F.lead(_number(value)).over(order) - _number(value)
        return rows.withColumn("__energy", F.coalesce(step * step, F.lit(0.0)))

    summed = window_sum(framed(df, keys, position, 0, 1, energy), keys, position, "__energy", integrate, out="__sum")
    peak = summed.groupBy(*map(quoted, keys)).agg((F.max("__sum") * threshold).alias("__least"))
    masked = join_summary(summed, peak, keys).withColumn("__on", F.coalesce(F.col("__sum") > F.col("__least"), F.lit(False)))
    w = Window.partitionBy(*map(quoted, keys)).orderBy(quoted(position))
    begins = (F.col("__on") & ~F.coalesce(F.lag("__on").over(w), F.lit(False))).cast("int")
    numbered = masked.withColumn("__begins", begins).withColumn("region", F.sum("__begins").over(w)).where("__on")
    top = F.max(F.struct(_number(value).alias("v"), (-quoted(position)).alias("p")))
    found = numbered.groupBy(*map(quoted, keys), "region").agg(F.min(quoted(position)).alias("low"), F.max(quoted(position)).alias("high"), top.alias("__top"))
    return found.select(*map(quoted, keys), "region", "low", "high", (-F.col("__top.p")).alias(position), F.col("__top.v").alias(value))


def slope_sum_onsets(df: DataFrame, keys: list[str], position: str, value: str, *, width: int, level: float = 0.6) -> DataFrame:
    """Onsets of pulses: where the sum of the rises of the last ``width`` positions passes ``level`` times its mean upwards.

    Returns keys, onset (the lowest sample of the ``width`` positions up to the crossing; equal ones: the earliest) and crossing.
    """

    def rises(rows: DataFrame, frame, order) -> DataFrame:
        step = _number(value) - F.lag(_number(value)).over(order)
        rows = rows.withColumn("__rise", F.greatest(F.coalesce(step, F.lit(0.0)), F.lit(0.0)))
        rows = rows.withColumn("__sum", F.round(_total(F.col("__rise"), frame, 1 - width, 0), 9))
        lowest = F.min(F.when(_number(value).isNotNull(), F.struct(_number(value).alias("v"), quoted(position).alias("p"))))
        return rows.withColumns({"__before": F.lag("__sum").over(order), "__low": lowest.over(frame(-width, 0))})

    summed = framed(df, keys, position, width + 1, 0, rises)
    mean = summed.groupBy(*map(quoted, keys)).agg(F.round(F.avg("__sum") * level, 9).alias("__least"))
    crossing = join_summary(summed, mean, keys).where((F.col("__sum") > F.col("__least")) & (F.col("__before") <= F.col("__least")))
    return crossing.select(*map(quoted, keys), F.col("__low.p").alias("onset"), quoted(position).alias("crossing"))


def regular_spans(df: DataFrame, keys: list[str], position: str, value: str, *, short: int, long: int, low: float, high: float, patch: int, least: int, most: int) -> DataFrame:
    """Spans of good signal: where its regularity lies within (low, high).

    Gaps of at most ``patch`` positions are patched, spans under ``least`` positions dropped and longer ones cut into
    spans of ``most``. Returns keys, low, high (both inclusive).
    """
    from pulseloom.operators.intervals import split_at_bins

    good = regularity(df, keys, position, value, short, long).where((F.col("regularity") > low) & (F.col("regularity") < high))
    spans = cluster_by_gap(good, keys, position, patch).where(F.col("last") - F.col("first") + 1 >= least)
    cut = split_at_bins(spans.select(*map(quoted, keys), F.col("first").alias("from"), F.lit(0).cast("bigint").alias("low"), (F.col("last") - F.col("first") + 1).alias("high")), "low", "high", most)
    return cut.select(*map(quoted, keys), (F.col("from") + F.col("low")).alias("low"), (F.col("from") + F.col("high") - 1).alias("high"))


def filter_channels(df: DataFrame, ids: list[str], samples: str, rate: str, cutoff: float | tuple[float, float], *, kind: str = "band", order: int = 3) -> DataFrame:
    """Zero-phase Butterworth filter of array channels: ids, rate and the filtered samples; missing samples are held.

    Null and very short channels (under ten samples) are dropped; an upper cutoff is lowered to 0.45 of a slow channel's rate.
    """

    def apply(x: np.ndarray, fs: float) -> np.ndarray:
        edge = tuple(min(c, 0.45 * fs) for c in cutoff) if isinstance(cutoff, tuple) else min(cutoff, 0.45 * fs)
        return kernels.zero_phase(x, kernels.butterworth(order, edge, fs, kind))

    return _map_channels(df, ids, samples, rate, apply)


def detrend_channels(df: DataFrame, ids: list[str], samples: str, rate: str, *, order: int = 3, seconds: float = 4.0) -> DataFrame:
    """Array channels without their slow trend: a least-squares polynomial over ``seconds``, averaged over one second.

    Missing samples are held; null and very short channels (under ten samples) are dropped.
    """

    def apply(x: np.ndarray, fs: float) -> np.ndarray:
        width = max(order + 2, int(seconds * fs)) // 2 * 2 + 1
        return kernels.without_trend(x, fs, np.asarray(polynomial_weights(order, width)))

    return _map_channels(df, ids, samples, rate, apply)


def _map_channels(df: DataFrame, ids: list[str], samples: str, rate: str, apply: Callable[[np.ndarray, float], np.ndarray]) -> DataFrame:
    """Replace array channels by ``apply(matrix, rate)``, channels of one rate and length together."""
    rows = df.where((F.size(samples) >= 10) & (quoted(rate) > 0)).select(*map(quoted, ids), quoted(rate).cast("double").alias(rate), quoted(samples).alias(samples))
    schema = T.StructType([*rows.drop(samples).schema.fields, T.StructField(samples, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [None] * batch.num_rows
            rates = batch.column(rate).to_numpy()
            channels = [np.asarray(x.values.to_numpy(zero_copy_only=False), float) for x in batch.column(samples)]
            alike: dict[tuple[float, int], list[int]] = {}
            for i, x in enumerate(channels):
                alike.setdefault((float(rates[i]), len(x)), []).append(i)
            for (fs, _), own in alike.items():
                for i, x in zip(own, apply(kernels.held(np.stack([channels[i] for i in own])), fs), strict=True):
                    out[i] = x
            yield pa.record_batch([*(batch.column(c) for c in ids), batch.column(rate), pa.array(out, pa.list_(pa.float64()))], names=[*ids, rate, samples])

    return rows.mapInArrow(run, schema)


def steepest(df: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """Position and size of each entity's steepest rise and fall between neighbouring samples; equal steps: the earliest."""

    def add(rows: DataFrame, _, order) -> DataFrame:
        return rows.withColumn("__step", F.lead(_number(value)).over(order) - _number(value))

    stepped = framed(df, keys, position, 0, 1, add).where("__step is not null")
    up, down = F.struct(F.col("__step").alias("s"), (-quoted(position)).alias("p")), F.struct((-F.col("__step")).alias("s"), (-quoted(position)).alias("p"))
    best = stepped.groupBy(*map(quoted, keys)).agg(F.max(up).alias("__up"), F.max(down).alias("__down"))
    return best.select(*map(quoted, keys), (-F.col("__up.p")).alias("rise_at"), F.col("__up.s").alias("rise"), (-F.col("__down.p")).alias("fall_at"), (-F.col("__down.s")).alias("fall"))


def heart_rate(beats: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Mean of 60 over the interval between successive distinct beat times (seconds), and the number of intervals."""
    w = Window.partitionBy(*map(quoted, keys)).orderBy(quoted(at))
    gaps = beats.select(*map(quoted, keys), quoted(at)).distinct().withColumn("__gap", quoted(at) - F.lag(quoted(at)).over(w))
    return gaps.where("__gap > 0").groupBy(*map(quoted, keys)).agg(F.avg(60 / F.col("__gap")).alias("heart_rate"), F.count("*").alias("n_intervals"))


def label_cycles(beats: DataFrame, keys: list[str], at: str, *, memory: int = 15, tolerance: float = 0.12, long_factor: float = 1.6) -> DataFrame:
    """Label each interval between beats against the mean of the last ``memory`` accepted ones.

    Labels: "start" (too few accepted ones yet), "ok" (within ``tolerance``), "long" (over ``long_factor`` times the
    mean), "short" and "late" (beyond the tolerance). Only "start" and "ok" intervals are accepted; after ``memory``
    refused ones in a row the memory is emptied. Beats of an entity pass through one task in order; the state is the
    accepted intervals. Null times are dropped, repeated ones taken once.
    """
    rows = beats.where(quoted(at).isNotNull()).select(*map(quoted, keys), quoted(at).cast("double").alias("__at")).distinct()
    schema = T.StructType([*rows.select(*map(quoted, keys)).schema.fields, T.StructField("beat_at", T.DoubleType()), T.StructField("interval", T.DoubleType()), T.StructField("label", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, refused = None, None, 0
        accepted: deque[float] = deque(maxlen=memory)
        for batch in batches:
            owner, intervals, labels = [], [], []
            columns = [batch.column(k).to_pylist() for k in keys]
            for i, (own, t) in enumerate(zip(zip(*columns, strict=True), batch.column("__at").to_pylist(), strict=True)):
                if own != key:
                    key, last, refused = own, None, 0
                    accepted.clear()
                if last is not None:
                    interval = t - last
                    label, take = judge_interval(interval, accepted, tolerance, long_factor)
                    refused = 0 if take else refused + 1
                    if take:
                        accepted.append(interval)
                    elif refused >= memory:
                        accepted.clear()
                    owner.append(i)
                    intervals.append(interval)
                    labels.append(label)
                last = t
            if owner:
                at_ = pa.array(owner)
                yield pa.record_batch([*(batch.column(k).take(at_) for k in keys), batch.column("__at").take(at_), pa.array(intervals), pa.array(labels)], schema=arrow)

    return rows.repartition(*map(quoted, keys)).sortWithinPartitions(*map(quoted, keys), "__at").mapInArrow(run, schema)


def judge_interval(interval: float, accepted: deque[float], tolerance: float, long_factor: float) -> tuple[str, bool]:
    """(label, accepted?) of an interval against those accepted before."""
    if len(accepted) < 3:
        return "start", True
    mean = sum(accepted) / len(accepted)
    if abs(interval - mean) <= tolerance * mean:
        return "ok", True
    if interval > long_factor * mean:
        return "long", False
    return ("short" if interval < mean else "late"), False


def detect_beats(df: DataFrame, ids: list[str], samples: str, rate: str, *, low_hz: float = 5.0, high_hz: float = 15.0, window_sec: float = 0.15, refractory_sec: float = 0.25, decay_sec: float = 1.5) -> DataFrame:
    """Beats of sampled channels: rows (ids, idx), idx being the channel's largest deflection at the beat.

    Band-pass, slope, square and moving integral; a beat is where the integral exceeds a level that follows the beats
    found so far and decays between them. The channels of an Arrow batch advance together, one vector operation for
    each sample. Null arrays and channels under one second have no beats; missing samples are held.
    """
    rows = df.where((F.size(samples) > quoted(rate)) & (quoted(rate) > 0)).select(*map(quoted, ids), quoted(samples).alias("__x"), quoted(rate).cast("double").alias("__rate"))
    schema = T.StructType([*rows.select(*map(quoted, ids)).schema.fields, T.StructField("idx", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rates = batch.column("__rate").to_numpy(zero_copy_only=False)
            for fs in np.unique(rates):
                own = np.flatnonzero(rates == fs)
                for start in range(0, len(own), 128):
                    some = own[start : start + 128]
                    x = kernels.padded([np.asarray(batch.column("__x")[int(i)].values.to_numpy(zero_copy_only=False), float) for i in some])
                    row, idx = kernels.adaptive_beats(x, fs, low_hz, high_hz, window_sec, refractory_sec, decay_sec)
                    if len(row):
                        owner = pa.array(some[row])
                        yield pa.record_batch([*(batch.column(c).take(owner) for c in ids), pa.array(idx, pa.int64())], schema=arrow)

    return rows.mapInArrow(run, schema)
