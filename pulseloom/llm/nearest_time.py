"""Matching records of two tables by nearest time.

Both tables are laid out together by entity and time range; right rows near a range's edge are copied into the
neighbouring range, so a left row finds all candidates within the tolerance where it is. Inside a task the right
rows of a range come first and in time order, and a binary search over whole Arrow batches finds each left row's
two neighbours. A busy entity is spread over its ranges; only the right rows of one range, one for each distinct time,
are held at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulseloom.functions.common import quoted


def first_not_below(times: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each i the first position in times[lo[i]:hi[i]], ascending, that is not below wanted[i]; hi[i] if none."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        middle = (lo + hi) // 2
        below = open_ & (times[np.minimum(middle, len(times) - 1)] < wanted)
        lo = np.where(below, middle + 1, lo)
        hi = np.where(open_ & ~below, middle, hi)
    return lo


def _changes(batch: pa.RecordBatch, keys: list[str], last: dict | None) -> np.ndarray:
    """True where a row's keys differ from those of the row before; a null key differs from everything."""
    n = batch.num_rows
    changed = np.zeros(n, bool)
    for key in keys:
        column = batch.column(key)
        differs = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, n - 1)), True)
        changed[1:] |= differs.to_numpy(zero_copy_only=False)
    changed[0] = last is None or any(
        last[key] is None or batch.column(key)[0].as_py() != last[key] for key in keys
    )
    return changed


def _match(
    batches: Iterator[pa.RecordBatch], keys: list[str], carried: list[str], found: list[str], tolerance: float, inner: bool, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None  # right rows of the range that is still open
    last: dict | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.cumsum(_changes(batch, keys, last))
        last = {key: batch.column(key)[batch.num_rows - 1].as_py() for key in keys}
        side = batch.column("__side").to_numpy(zero_copy_only=False)
        time = batch.column("__time").to_numpy(zero_copy_only=False)
        table = pa.Table.from_batches([batch])

        right = np.flatnonzero(side == 0)
        if len(right):  # one right row for each distinct time of a range
            g, t = group[right], time[right]
            keep = np.ones(len(right), bool)
            keep[1:] = (g[1:] != g[:-1]) | (t[1:] != t[:-1])
            if held is not None and held.num_rows and g[0] == 0 and held["__time"][-1].as_py() == t[0]:
                keep[0] = False
            right = right[keep]
        parts = table.select([*found, "__time"]).take(pa.array(right))
        right_group = group[right]
        if held is not None and held.num_rows:
            right_group = np.concatenate([np.zeros(held.num_rows, right_group.dtype), right_group])
            parts = pa.concat_tables([held, parts])
        parts = parts.combine_chunks()
        right_time = parts["__time"].to_numpy()

        left = np.flatnonzero(side > 0)
        if len(left):
            t, g = time[left], group[left]
            lo, hi = np.searchsorted(right_group, g, "left"), np.searchsorted(right_group, g, "right")
            hi = np.where(side[left] == 1, hi, lo)  # rows without entity or time match nothing
            at = first_not_below(right_time, lo, hi, t)
            padded = np.append(right_time, np.inf)
            before = np.where(at > lo, np.abs(t - padded[at - 1]), np.inf)
            after = np.where(at < hi, np.abs(padded[np.minimum(at, len(right_time))] - t), np.inf)
            index = np.where(before <= after, at - 1, at)
            distance = np.minimum(before, after)
            hit = distance <= tolerance
            if inner:
                left, index, distance, hit = left[hit], index[hit], distance[hit], hit[hit]
            taken = parts.take(pa.array(index, mask=~hit))
            own = table.take(pa.array(left))
            columns = [own[c] for c in carried] + [taken[c] for c in found] + [pa.array(distance, mask=~hit)]
            result = pa.table(columns, schema=schema).combine_chunks()
            yield from result.to_batches()

        open_ = right_group == group[-1]
        held = parts.filter(pa.array(open_))


def match_nearest_time(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    tolerance: float,
    take: dict[str, str],
    *,
    distance: str = "time_distance",
    range_len: float | None = None,
    how: str = "left",
    distinct: bool = False,
) -> DataFrame:
    """Give each left row the nearest right row in time of the same entity.

    :param keys: columns of both tables that name the entity.
    :param tolerance: largest distance; a right row exactly that far off counts.
    :param take: right columns to return and the names they get.
    :param distance: name of the column for the distance found.
    :param range_len: length of the time ranges, at least ten tolerances by default.
    :param how: "left" keeps left rows without a match (nulls), "inner" drops them.
    :param distinct: return one row for each distinct left row and match.

    Defined cases: equal distances: the earlier right row; several right rows at one time: the one smallest in its
    taken columns, nulls first; null keys, null, NaN or infinite times: no match; repeated left rows: each is matched
    (or one, with ``distinct``); an empty table: no match. Other columns of the right table are ignored, those of the
    left one are kept; a taken or distance name that the left table has already is an error.
    """
    clash = ({*take.values()} | {distance}) & {*left.columns}
    if clash:
        raise ValueError(f"columns of the left table would be lost: {sorted(clash)}")
    span = float(range_len or max(600.0, 10 * tolerance))
    if span < tolerance:
        raise ValueError("a time range must not be shorter than the tolerance")
    carried = list(left.columns)
    key_as, found = [f"__key{i}" for i in range(len(keys))], [f"__got{i}" for i in range(len(take))]
    time = lambda name: quoted(name).cast("double")
    usable = lambda df, name: time(name).isNotNull() & ~F.isnan(time(name)) & (F.abs(time(name)) != float("inf"))

    known = usable(left, left_time)
    for key in keys:
        known = known & quoted(key).isNotNull()
    lefts = left.select(
        *(quoted(k).alias(a) for k, a in zip(keys, key_as, strict=True)),
        F.when(known, F.floor(time(left_time) / span)).otherwise(F.pmod(F.xxhash64(*map(quoted, carried)), F.lit(4096))).alias("__range"),
        F.when(known, F.lit(1)).otherwise(F.lit(2)).alias("__side"),
        F.when(known, time(left_time)).otherwise(F.lit(0.0)).alias("__time"),
        F.struct(*map(quoted, carried)).alias("__left"),
        *(F.lit(None).cast(right.schema[c].dataType).alias(a) for c, a in zip(take, found, strict=True)),
    )
    rows = right.where(usable(right, right_time))
    for key in keys:
        rows = rows.where(quoted(key).isNotNull())
    low, high = F.floor((time(right_time) - tolerance) / span), F.floor((time(right_time) + tolerance) / span)
    middle = F.floor(time(right_time) / span)
    rights = rows.select(
        *(quoted(k).alias(a) for k, a in zip(keys, key_as, strict=True)),
        F.explode(F.array_distinct(F.array(low, middle, high))).alias("__range"),
        F.lit(0).alias("__side"),
        time(right_time).alias("__time"),
        F.lit(None).cast(lefts.schema["__left"].dataType).alias("__left"),
        *(quoted(c).alias(a) for c, a in zip(take, found, strict=True)),
    )
    both = lefts.union(rights).repartition(*key_as, "__range")
    flat = both.select(*key_as, "__range", "__side", "__time", *(F.col("__left")[c].alias(f"__c{i}") for i, c in enumerate(carried)), *found)
    if distinct:
        flat = flat.dropDuplicates()
    flat = flat.sortWithinPartitions(*key_as, "__range", "__side", "__time", *found)
    own = [f"__c{i}" for i in range(len(carried))]
    out = T.StructType(
        [T.StructField(c, left.schema[name].dataType) for c, name in zip(own, carried, strict=True)]
        + [T.StructField(a, right.schema[c].dataType) for c, a in zip(take, found, strict=True)]
        + [T.StructField("__distance", T.DoubleType())]
    )
    arrow, inner = to_arrow_schema(out), how == "inner"
    matched = flat.mapInArrow(
        lambda batches: _match(batches, [*key_as, "__range"], own, found, float(tolerance), inner, arrow), out
    )
    return matched.select(
        *(F.col(c).alias(name) for c, name in zip(own, carried, strict=True)),
        *(F.col(a).alias(name) for a, name in zip(found, take.values(), strict=True)),
        F.col("__distance").alias(distance),
    )
