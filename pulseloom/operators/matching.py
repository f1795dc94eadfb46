"""Matching of two event series of an entity: beats and valleys, next events, lookups.

Event pairs are found by equi-joins on an entity and a time cell that is as long as the reach of the match, so both
neighbouring cells are enough; a busy entity is spread over its cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions.common import broadcast_if_small, cut, join_summary, quoted
from pulseloom.functions.kernels import second_valley


def with_neighbours(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Add ``prev_at`` and ``next_at``, the neighbouring distinct times of the entity."""
    w = Window.partitionBy(*map(quoted, keys)).orderBy(quoted(at))
    return df.withColumns({"prev_at": F.lag(quoted(at)).over(w), "next_at": F.lead(quoted(at)).over(w)})


def _within(left: DataFrame, right: DataFrame, keys: list[str], low: Column, high: Column, at: str, cell: float) -> DataFrame:
    """Left rows joined with the right rows whose ``at`` lies between ``low`` and ``high``, ends included."""
    first, last = F.floor(low / cell), F.floor(high / cell)
    wide = left.where(low.isNotNull() & high.isNotNull() & (low <= high)).withColumn("__cell", F.explode(F.sequence(first, last)))
    return wide.join(right.withColumn("__cell", F.floor(quoted(at) / cell)), [*keys, "__cell"]).where((quoted(at) >= low) & (quoted(at) <= high)).drop("__cell")


def match_between_neighbours(peaks: DataFrame, valleys: DataFrame, keys: list[str], peak_at: str, valley_at: str, *, end_at: str | None = None, cell: float = 4.0) -> DataFrame:
    """Give each peak the nearest valley between its two neighbouring peaks, null if there is none.

    The first peak looks from 0 and the last one as far as ``end_at`` of its row, or without one ``cell`` ahead.
    Equally near valleys: the earlier one. Distinct times are expected; peaks and valleys are compared in seconds.
    """
    own = with_neighbours(peaks.select(*map(quoted, keys), quoted(peak_at), *([quoted(end_at)] if end_at else [])), keys, peak_at)
    low = F.coalesce("prev_at", F.lit(0.0))
    high = F.coalesce("next_at", quoted(end_at) if end_at else quoted(peak_at) + cell)
    right = valleys.select(*map(quoted, keys), quoted(valley_at))
    pairs = _within(own, right, keys, low, high, valley_at, cell)
    best = pairs.groupBy(*map(quoted, keys), quoted(peak_at)).agg(F.min(F.struct(F.abs(quoted(valley_at) - quoted(peak_at)).alias("d"), quoted(valley_at).alias("v"))).alias("__best"))
    chosen = best.select(*map(quoted, keys), quoted(peak_at), F.col("__best.v").alias(valley_at))
    return own.select(*map(quoted, keys), quoted(peak_at)).join(chosen, [*keys, peak_at], "left")


def plausible_peaks(peaks: DataFrame, valleys: DataFrame, keys: list[str]) -> DataFrame:
    """Peaks of the entities that have at least half and at most one and a half times as many peaks as valleys."""
    count = lambda df, name: df.groupBy(*map(quoted, keys)).agg(F.count("*").alias(name))
    both = count(peaks, "__n_peaks").join(count(valleys, "__n_valleys"), keys, "left").fillna(0, ["__n_valleys"])
    good = both.where((F.col("__n_peaks") >= F.col("__n_valleys") / 2) & (F.col("__n_peaks") <= F.col("__n_valleys") * 1.5))
    return peaks.join(good.select(*map(quoted, keys)), keys, "left_semi")


def add_unmatched(pairs: DataFrame, valleys: DataFrame, keys: list[str], peak_at: str, valley_at: str) -> DataFrame:
    """Append the valleys that no pair uses, with a null peak."""
    free = valleys.select(*map(quoted, keys), quoted(valley_at)).distinct().join(pairs.select(*map(quoted, keys), quoted(valley_at)), [*keys, valley_at], "left_anti")
    return pairs.unionByName(free.withColumn(peak_at, F.lit(None).cast(pairs.schema[peak_at].dataType)))


def _settled(pairs: DataFrame, keys: list[str], peak_at: str, valley_at: str) -> DataFrame:
    """Pairs in the order of their valleys, with what a peak that shares its valley with a nearer one is to do."""
    shared = Window.partitionBy(*map(quoted, keys), quoted(valley_at))
    by_distance = shared.orderBy(F.abs(quoted(peak_at) - quoted(valley_at)), quoted(peak_at))
    paired = quoted(valley_at).isNotNull() & quoted(peak_at).isNotNull()
    ranked = pairs.withColumns({"__place": F.when(paired, F.row_number().over(by_distance)), "__n": F.count(quoted(peak_at)).over(shared)})
    order = Window.partitionBy(*map(quoted, keys)).orderBy(quoted(valley_at).asc_nulls_first(), F.col("__place").asc_nulls_last(), quoted(peak_at))
    free_next = F.lead(quoted(peak_at)).over(order).isNull() & F.lead(quoted(valley_at)).over(order).isNotNull()
    lost = (F.col("__place") == 2) & (F.col("__n") == 2)
    marked = ranked.withColumns(
        {
            "__takes": F.coalesce(lost & free_next, F.lit(False)),
            "__next": F.lead(quoted(valley_at)).over(order),
            "__before": F.lag(quoted(valley_at), 2).over(order),
            "__later": quoted(peak_at) > F.lag(quoted(peak_at)).over(order),
        }
    )
    marked = marked.withColumn("__taken", F.coalesce(F.lag("__takes").over(order), F.lit(False)) & quoted(peak_at).isNull())
    return marked.where(~F.col("__taken")).withColumn("__searches", F.coalesce(lost & ~F.col("__takes") & F.col("__next").isNotNull(), F.lit(False)))


def settle_shared(pairs: DataFrame, keys: list[str], peak_at: str, valley_at: str) -> DataFrame:
    """Let each valley serve one peak: of several the nearest keeps it, the others get a neighbouring free valley or null.

    Of two peaks the one that lost its valley takes the next valley in order if no peak uses that one.
    Expects the output of :func:`add_unmatched`.
    """
    valley = F.when(F.col("__takes"), F.col("__next")).when(F.col("__place") > 1, None).otherwise(quoted(valley_at))
    return _settled(pairs, keys, peak_at, valley_at).select(*map(quoted, keys), quoted(peak_at), valley.alias(valley_at))


def settle_all(pairs: DataFrame, samples: DataFrame, keys: list[str], peak_at: str, valley_at: str, sample_at: str, value: str, *, how: str = "how", cell: float = 4.0) -> DataFrame:
    """:func:`settle_shared` that leaves no peak without a time, and says in ``how`` where it comes from.

    "own": the peak's nearest valley; "next": the next free one; "searched": the least of the samples between the first two
    smoothed peaks, towards the next valley for the later of two peaks, towards the one before for the earlier one;
    "peak": the peak's own time, where more than two peaks share a valley, there is no further valley, or the samples
    (``sample_at`` in the unit of the peaks) hold no two peaks. Valleys without a peak are "unpaired".
    """
    rows = _settled(pairs, keys, peak_at, valley_at).withColumn("__at", quoted(peak_at))
    searching = rows.where("__searches")
    low = F.when(F.col("__later"), quoted(valley_at)).otherwise(F.coalesce("__before", F.lit(0.0)))
    high = F.when(F.col("__later"), F.col("__next")).otherwise(quoted(valley_at))
    gaps = searching.select(*map(quoted, keys), low.alias("__low"), high.alias("__high"), "__later", "__at")
    gaps = gaps.groupBy(*map(quoted, keys), "__low", "__high").agg(F.max(F.when(F.col("__later"), F.col("__at"))).alias("__first"), F.max(F.when(~F.col("__later"), F.col("__at"))).alias("__second"))
    wave = samples.select(*map(quoted, keys), quoted(sample_at).alias("__sec"), quoted(value).cast("double").alias("__value"))
    inside = _within(broadcast_if_small(cut(gaps)), wave, keys, F.col("__low"), F.col("__high"), "__sec", cell)
    collected = inside.groupBy(*map(quoted, keys), "__low", "__high", "__first", "__second").agg(F.array_sort(F.collect_list(F.struct("__sec", "__value"))).alias("__wave"))
    collected = collected.select(*map(quoted, keys), "__first", "__second", F.col("__wave.__sec").alias("__sec"), F.col("__wave.__value").alias("__value"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which: list[int] = []
            found: list[tuple[float, float]] = []
            columns = (batch.column(c).to_pylist() for c in ("__first", "__second", "__sec", "__value"))
            for i, (first, second, sec, y) in enumerate(zip(*columns, strict=True)):
                at, y, begin = np.array(sec), np.array(y, float), 0
                if first is not None:
                    k = second_valley(y)
                    if k is not None:
                        which.append(i)
                        found.append((first, float(at[k])))
                    begin = int(np.searchsorted(at, first)) if k is None else k  # what the later peak got bounds the earlier one's search
                if second is not None and (k := second_valley(y[begin:])) is not None:
                    which.append(i)
                    found.append((second, float(at[begin + k])))
            if which:
                part = batch.select(keys).take(pa.array(which))
                yield pa.record_batch([*part.columns, *(pa.array(c, pa.float64()) for c in zip(*found, strict=True))], names=[*keys, "__at", "__found"])

    schema = collected.select(*map(quoted, keys), F.lit(0.0).alias("__at"), F.lit(0.0).alias("__found")).schema
    settled = rows.join(broadcast_if_small(cut(collected.mapInArrow(search, schema))), [*keys, "__at"], "left")
    own = quoted(valley_at).isNotNull() & (F.col("__place") == 1)
    source = F.when(quoted(peak_at).isNull(), "unpaired").when(own, "own").when(F.col("__takes"), "next").when(F.col("__found").isNotNull(), "searched").otherwise("peak")
    at = F.when(source.isin("unpaired", "own"), quoted(valley_at)).when(source == "next", F.col("__next")).when(source == "searched", F.col("__found")).otherwise(quoted(peak_at))
    return settled.select(*map(quoted, keys), quoted(peak_at), at.alias(valley_at), source.alias(how))


def next_within(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, *, reach: float, delay: str = "delay") -> DataFrame:
    """The first right event after each left event and before the next left one, at most ``reach`` later; null if none."""
    own = with_neighbours(left.select(*map(quoted, keys), quoted(left_at)).distinct(), keys, left_at)
    high = F.least(F.coalesce("next_at", quoted(left_at) + reach), quoted(left_at) + reach)
    pairs = _within(own, right.select(*map(quoted, keys), quoted(right_at)).distinct(), keys, quoted(left_at), high, right_at, reach)
    pairs = pairs.where((quoted(right_at) > quoted(left_at)) & (F.col("next_at").isNull() | (quoted(right_at) < F.col("next_at"))))
    first = pairs.groupBy(*map(quoted, keys), quoted(left_at)).agg(F.min(quoted(right_at)).alias(right_at))
    return own.select(*map(quoted, keys), quoted(left_at)).join(first, [*keys, left_at], "left").withColumn(delay, quoted(right_at) - quoted(left_at))


def mutual_matches(pairs: DataFrame, keys: list[str], left_at: str, right_at: str) -> DataFrame:
    """Of forward matches (left, right) keep the latest left event for each right one, so both series alternate."""
    return pairs.where(quoted(right_at).isNotNull()).groupBy(*map(quoted, keys), quoted(right_at)).agg(F.max(quoted(left_at)).alias(left_at))


def nearest_in_series(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, *, cell: float) -> DataFrame:
    """Rows (keys, left_at, right_at): for each distinct left time the nearest right one of the same key, however far; of two as near the earlier.

    Times are ordered inside cells of ``cell`` units; only the first and last right time of each cell are carried to the
    others. Null times don't count; equal null keys meet; left times of keys without a right one get null.
    """
    names = [f"k{i}" for i in range(len(keys))]
    times = lambda df, at: df.where(quoted(at).isNotNull()).select(*(quoted(k).alias(a) for k, a in zip(keys, names, strict=True)), quoted(at).alias("t")).distinct()
    one, other = times(left, left_at), times(right, right_at)
    both = one.withColumn("r", F.lit(None).cast(other.schema["t"].dataType)).unionByName(other.withColumn("r", F.col("t"))).withColumn("cell", F.floor(F.col("t") / cell))
    place = Window.partitionBy(*names, "cell").orderBy("t", F.col("r").asc_nulls_last())
    near = {"before": F.last("r", ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, 0)), "after": F.first("r", ignorenulls=True).over(place.rowsBetween(0, Window.unboundedFollowing))}
    rows = both.withColumns(near).where("r is null").drop("r")
    cells = both.groupBy(*names, "cell").agg(F.min("r").alias("low"), F.max("r").alias("high"))
    order = Window.partitionBy(*names).orderBy("cell")
    carried = cells.select(
        *names,
        "cell",
        F.last("high", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
        F.first("low", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
    )
    rows = join_summary(rows, carried, [*names, "cell"])
    before, after = F.coalesce("before", "earlier"), F.coalesce("after", "later")
    nearest = F.when(before.isNull() | (after - F.col("t") < F.col("t") - before), after).otherwise(before)
    return rows.select(*(F.col(a).alias(k) for k, a in zip(keys, names, strict=True)), F.col("t").alias(left_at), nearest.alias(right_at))


def nearest_grid_index(seconds: Column, rate: Column, length: Column | None = None) -> Column:
    """Index of the sample nearest to a time on a regular grid, within 0..length-1."""
    index = F.greatest(F.round(seconds * rate).cast("bigint"), F.lit(0).cast("bigint"))
    return index if length is None else F.least(index, length - 1)


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """Left outer join with the first right row in ``order`` of each key."""
    rest = [c for c in right.columns if c not in on and c not in order]
    first = right.groupBy(*map(quoted, on)).agg(F.min(F.struct(*map(quoted, order), *map(quoted, rest))).alias("__first"))
    return left.join(first, on, "left").select(*(quoted(c) for c in left.columns), *(F.col("__first")[c].alias(c) for c in [*order, *rest]))


def count_members(left: DataFrame, right: DataFrame, on: str, out: str = "n_members") -> DataFrame:
    """How often each left value occurs in the right table."""
    counts = right.where(quoted(on).isNotNull()).groupBy(quoted(on)).agg(F.count("*").alias(out))
    return left.join(counts, on, "left").fillna(0, [out])
