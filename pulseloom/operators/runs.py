"""Run-length coding and one-dimensional clustering of ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions.common import quoted

#: Positions whose runs are formed in one task before runs are joined across stretches.
STRETCH = 65_536


def encode_runs(df: DataFrame, keys: list[str], position: str, value: str, *, stretch: int = STRETCH) -> DataFrame:
    """Run-length code of ``value`` in order of the integer ``position``: keys, run_no, value, n, first_position, last_position.

    Runs are formed within stretches of positions first; only runs, not rows, are then joined over an entity's
    stretches. Nulls are equal to each other and so are NaNs; positions may have holes, which end no run; rows with a
    null position are dropped; repeated positions are ordered by value.
    """
    part = F.floor(quoted(position) / stretch)
    rows = df.where(quoted(position).isNotNull()).withColumn("__part", part)
    inside = Window.partitionBy(*map(quoted, keys), "__part").orderBy(quoted(position), quoted(value))
    lagged = F.lag(F.struct(quoted(value).alias("v"))).over(inside)
    starts = (lagged.isNull() | ~quoted(value).eqNullSafe(lagged["v"])).cast("int")
    marked = rows.withColumn("__new", starts).withColumn("__run", F.sum("__new").over(inside))
    pieces = marked.groupBy(*map(quoted, keys), "__part", "__run").agg(
        F.first(quoted(value)).alias("__value"), F.count("*").alias("__n"), F.min(quoted(position)).alias("__low"), F.max(quoted(position)).alias("__high")
    )
    whole = Window.partitionBy(*map(quoted, keys)).orderBy("__low", "__part", "__run")
    previous = F.lag(F.struct("__value")).over(whole)
    begins = (previous.isNull() | ~F.col("__value").eqNullSafe(previous["__value"])).cast("int")
    numbered = pieces.withColumn("__begins", begins).withColumn("run_no", F.sum("__begins").over(whole))
    return numbered.groupBy(*map(quoted, keys), "run_no").agg(
        F.first("__value").alias(value), F.sum("__n").alias("n"), F.min("__low").alias("first_position"), F.max("__high").alias("last_position")
    )


def decode_runs(df: DataFrame, keys: list[str], order: str, value: str, n: str, *, block: int = 4096) -> DataFrame:
    """Rows (keys, position, value) of run-length coded rows; positions count from 0. Runs with null or non-positive ``n`` are empty."""
    upto = Window.partitionBy(*map(quoted, keys)).orderBy(quoted(order)).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.where(quoted(n) > 0).withColumn("__from", F.coalesce(F.sum(quoted(n)).over(upto), F.lit(0)).cast("bigint"))
    rows = rows.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((quoted(n) - 1) / block))))
    low = F.col("__block") * block
    offsets = F.sequence(low, F.least(low + block - 1, quoted(n).cast("bigint") - 1))
    return rows.withColumn("__at", F.explode(offsets)).select(*map(quoted, keys), (F.col("__from") + F.col("__at")).alias("position"), quoted(value))


def split_long_runs(df: DataFrame, n: str, limit: int = 255) -> DataFrame:
    """Split runs of more than ``limit`` rows into full ones and a rest; adds ``part_no``."""
    parts = F.sequence(F.lit(0).cast("bigint"), F.floor((quoted(n) - 1) / limit))
    wide = df.where(quoted(n) > 0).withColumn("part_no", F.explode(parts))
    return wide.withColumn(n, F.least(F.lit(limit).cast("bigint"), quoted(n) - F.col("part_no") * limit))


def cluster_by_gap(df: DataFrame, keys: list[str], order: str, eps: float | Column) -> DataFrame:
    """One-dimensional density clusters: rows at most ``eps`` apart in ``order`` belong together.

    Returns keys, cluster_no, first, last, n. Rows with a null order are dropped. A busy entity is a window partition
    of its own distinct positions, which are counted before they are moved.
    """
    points = df.where(quoted(order).isNotNull()).groupBy(*map(quoted, keys), quoted(order).alias("__at")).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*map(quoted, keys)).orderBy("__at")
    far = F.coalesce((F.col("__at") - F.lag("__at").over(w) > eps).cast("int"), F.lit(1))
    numbered = points.withColumn("__far", far).withColumn("cluster_no", F.sum("__far").over(w))
    return numbered.groupBy(*map(quoted, keys), "cluster_no").agg(F.min("__at").alias("first"), F.max("__at").alias("last"), F.sum("__n").alias("n"))


def merge_equal_neighbours(df: DataFrame, keys: list[str], order: str, label: str, start: str, end: str) -> DataFrame:
    """Glue neighbouring segments with one label: keys, group_no, label, start, end, n_segments."""
    w = Window.partitionBy(*map(quoted, keys)).orderBy(quoted(order))
    previous = F.lag(F.struct(quoted(label).alias("v"))).over(w)
    begins = (previous.isNull() | ~quoted(label).eqNullSafe(previous["v"])).cast("int")
    numbered = df.withColumn("__begins", begins).withColumn("group_no", F.sum("__begins").over(w))
    return numbered.groupBy(*map(quoted, keys), "group_no").agg(
        F.first(quoted(label)).alias(label), F.min(quoted(start)).alias(start), F.max(quoted(end)).alias(end), F.count("*").alias("n_segments")
    )
