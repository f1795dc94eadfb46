"""Irregular readings onto a regular grid, with gaps filled or marked.

Readings are reduced to slots of the grid first (count, mean, first and last reading), which happens before any row is
moved. An as-of merge of the sorted slots with the grid then gives every grid point its neighbours on both sides: a
slot's predecessor in time and the slot itself enclose all grid points between them. Slots are handled in stretches of
a source; only the first slot of a stretch looks back into an earlier one, over the stretches' edges alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions.common import is_number, quoted

#: Slots that are handled together.
STRETCH = 8192
#: Grid points that one row is expanded into at a time.
FAN_OUT = 4096


def regular_grid(df: DataFrame, keys: list[str], time: str, value: str, step: float, *, gap_limit: float) -> DataFrame:
    """One row per slot between the first and the last slot of a source that hold a reading.

    Columns: keys, ``slot_no`` (floor(time / step)), ``status``, ``n_readings``, ``slot_mean`` and ``value``, which is
    interpolated at the slot's beginning between the reading before and the reading after it, weighted by the time to
    each, if they are at most ``gap_limit`` apart, else null. Status: "observed" (the slot holds readings), "filled"
    (it holds none, but has a value) or "gap".

    Defined cases: null or NaN times or values are no readings; readings at the same time: the smallest value counts
    as a neighbour after, the largest as one before; a reading at the slot's very beginning is its value; the first
    slot has no reading before it and no value unless one is at its beginning; null keys are a source of their own;
    an empty table gives no rows; other columns are ignored.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*(quoted(k).alias(a) for k, a in zip(keys, names, strict=True)), quoted(time).cast("double").alias("t"), quoted(value).cast("double").alias("v"))
    rows = rows.where(is_number(F.col("t")) & is_number(F.col("v"))).withColumn("slot", F.floor(F.col("t") / step))
    reading = F.struct("t", "v")
    slots = rows.groupBy(*names, "slot").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min(reading).alias("first"), F.max(reading).alias("last"))

    slots = slots.withColumn("stretch", F.floor(F.col("slot") / STRETCH))
    inside = Window.partitionBy(*names, "stretch").orderBy("slot")
    before = F.struct("slot", "last")
    near = slots.withColumns({"prev": F.lag(before).over(inside), "edge": F.lag("slot").over(inside).isNull() | F.lead("slot").over(inside).isNull()})
    near = near.withColumn("place", F.when(~F.col("edge"), F.col("stretch")))
    edges = Window.partitionBy(*names, "place").orderBy("slot")
    near = near.withColumn("prev", F.coalesce("prev", F.when(F.col("edge"), F.lag(before).over(edges))))

    low = F.coalesce(F.col("prev.slot") + 1, F.col("slot"))
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("slot") - low) / FAN_OUT))
    wide = near.withColumn("low", low).withColumn("block", F.explode(blocks))
    start = F.col("low") + F.col("block") * FAN_OUT
    wide = wide.withColumn("slot_no", F.explode(F.sequence(start, F.least(start + FAN_OUT - 1, F.col("slot")))))

    at = F.col("slot_no") * step
    span = F.col("first.t") - F.col("prev.last.t")
    weight = (at - F.col("prev.last.t")) / span
    between = F.col("prev.last.v") + (F.col("first.v") - F.col("prev.last.v")) * weight
    exact = F.col("first.t") == at
    observed = F.col("slot_no") == F.col("slot")
    out = F.when(observed & exact, F.col("first.v")).when(span <= gap_limit, between)
    return wide.select(
        *(F.col(a).alias(k) for k, a in zip(keys, names, strict=True)),
        "slot_no",
        F.when(observed, "observed").when(out.isNotNull(), "filled").otherwise("gap").alias("status"),
        F.when(observed, F.col("n")).otherwise(F.lit(0)).alias("n_readings"),
        F.when(observed, F.col("mean")).alias("slot_mean"),
        out.alias("value"),
    )
