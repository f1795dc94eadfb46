"""Statistics in tumbling windows, over many features at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions.common import quoted

BLOCK = 4096


def unpivot(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """Long form (ids, feature, value) of feature columns, as doubles; NaN becomes null, nulls are kept."""
    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), F.nanvl(quoted(f).cast("double"), F.lit(None).cast("double")).alias("value")) for f in features))
    return df.select(*map(quoted, ids), F.explode(pairs).alias("__pair")).select(*map(quoted, ids), "__pair.feature", "__pair.value")


def window_statistics(df: DataFrame, keys: list[str], time: str, features: list[str], width: float) -> DataFrame:
    """Rows (keys, window_no, feature, n, n_null, avg, med, max, min, slope) of windows floor(time / width) that hold rows.

    ``slope`` is the least-squares slope over time, 0 for a single value. Rows without a time are dropped.
    """
    t = quoted(time).cast("double")
    rows = df.where(t.isNotNull() & ~F.isnan(t)).withColumns({"__t": t, "window_no": F.floor(t / width)})
    long = unpivot(rows, [*keys, "window_no", "__t"], features)
    v = F.col("value")
    slope = F.when(F.count(v) == 1, F.lit(0.0)).otherwise(F.regr_slope(v, F.col("__t")))
    return long.groupBy(*map(quoted, keys), "window_no", "feature").agg(
        F.count("*").alias("n"), (F.count("*") - F.count(v)).alias("n_null"), F.avg(v).alias("avg"), F.percentile(v, 0.5).alias("med"), F.max(v).alias("max"), F.min(v).alias("min"), slope.alias("slope")
    )


def window_quantiles(df: DataFrame, keys: list[str], time: str, features: list[str], width: float, ps: dict[str, float]) -> DataFrame:
    """Quantiles at the positions n p + 1/2 of the sorted values, interpolated and clamped to the ends: keys, window_no, feature and one column each.

    The values are ranked by a window that spills, so no group is held in memory.
    """
    t = quoted(time).cast("double")
    rows = df.where(t.isNotNull() & ~F.isnan(t)).withColumn("window_no", F.floor(t / width))
    long = unpivot(rows, [*keys, "window_no"], features).where("value is not null")
    group = [*map(quoted, keys), F.col("window_no"), F.col("feature")]
    ranked = long.withColumns({"__i": F.row_number().over(Window.partitionBy(*group).orderBy("value")), "__n": F.count("*").over(Window.partitionBy(*group))})

    def at(p: float) -> tuple[Column, Column]:
        place = F.least(F.greatest(F.col("__n") * p + 0.5, F.lit(1.0)), F.col("__n").cast("double"))
        low = F.floor(place)
        return low, place - low

    out = []
    for name, p in ps.items():
        low, part = at(p)
        below = F.max(F.when(F.col("__i") == low, F.col("value")))
        above = F.max(F.when(F.col("__i") == F.least(low + 1, F.col("__n")), F.col("value")))
        out.append((below + (above - below) * F.max(part)).alias(name))
    return ranked.groupBy(*group).agg(*out)


def fill_windows(stats: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Add the windows without rows, from 0 to an entity's last one, with nulls and n = 0."""
    last = stats.groupBy(*map(quoted, keys)).agg(F.max("window_no").alias("__last"))
    blocks = last.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("__last") / BLOCK))))
    low = F.col("__block") * BLOCK
    grid = blocks.withColumn("window_no", F.explode(F.sequence(low, F.least(low + BLOCK - 1, F.col("__last"))))).drop("__last", "__block")
    grid = grid.withColumn("feature", F.explode(F.array(*map(F.lit, features))))
    return grid.join(stats, [*keys, "window_no", "feature"], "left").fillna(0, ["n", "n_null"])


def window_categories(df: DataFrame, keys: list[str], time: str, category: str, codes: list, width: float) -> DataFrame:
    """Counts of each code in a window as n_<code>, and of everything else, null included, as n_other."""
    rows = df.where(quoted(time).isNotNull()).withColumn("window_no", F.floor(quoted(time) / width))
    counts = [F.count_if(quoted(category) == c).alias(f"n_{c}") for c in codes]
    other = F.count_if(quoted(category).isNull() | ~quoted(category).isin(codes)).alias("n_other")
    return rows.groupBy(*map(quoted, keys), "window_no").agg(*counts, other)


def window_runs(df: DataFrame, keys: list[str], time: str, state: str, width: float) -> DataFrame:
    """Runs of a state inside each window as two arrays in time order: ``states`` and ``lengths``. Ties in time are ordered by state."""
    from pulseloom.operators.runs import encode_runs

    rows = df.where(quoted(time).isNotNull()).withColumn("window_no", F.floor(quoted(time) / width))
    runs = encode_runs(rows, [*keys, "window_no"], time, state)
    ordered = F.sort_array(F.collect_list(F.struct("run_no", quoted(state).alias("s"), "n")))
    held = runs.groupBy(*map(quoted, keys), "window_no").agg(ordered.alias("__runs"))
    return held.select(*map(quoted, keys), "window_no", F.transform("__runs", lambda r: r["s"]).alias("states"), F.transform("__runs", lambda r: r["n"]).alias("lengths"))


def first_in_window(df: DataFrame, keys: list[str], time: str, tie: str, value: str, width: float) -> DataFrame:
    """The first value of each window; rows at the same time are ordered by ``tie``."""
    rows = df.where(quoted(time).isNotNull()).withColumn("window_no", F.floor(quoted(time) / width))
    first = F.min(F.struct(quoted(time).alias("t"), quoted(tie).alias("k"), quoted(value).alias("v")))
    return rows.groupBy(*map(quoted, keys), "window_no").agg(first.alias("__first")).select(*map(quoted, keys), "window_no", F.col("__first.v").alias("first_value"))


def epoch_fractions(df: DataFrame, keys: list[str], time: str, state: str, codes: list, width: float) -> DataFrame:
    """Share of each code among the rows of an epoch as share_<code>; null states count as none of them."""
    rows = df.where(quoted(time).isNotNull()).withColumn("epoch", F.floor(quoted(time) / width))
    return rows.groupBy(*map(quoted, keys), "epoch").agg(*(F.avg(F.coalesce((quoted(state) == c).cast("double"), F.lit(0.0))).alias(f"share_{c}") for c in codes))


def smallest_mode(df: DataFrame, keys: list[str], value: str, out: str = "mode") -> DataFrame:
    """Most frequent value of each entity; of equally frequent ones the smallest. Nulls don't count."""
    counts = df.where(quoted(value).isNotNull()).groupBy(*map(quoted, keys), quoted(value).alias("__v")).agg(F.count("*").alias("__n"))
    return counts.groupBy(*map(quoted, keys)).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col("__v").alias("v"))).alias("__best")).select(*map(quoted, keys), F.col("__best.v").alias(out))


def top_rows(df: DataFrame, keys: list[str], value: str, tie: str, k: int) -> DataFrame:
    """The ``k`` rows of each entity with the largest value, with their ``place``; equal values: smaller tie first, nulls last."""
    w = Window.partitionBy(*map(quoted, keys)).orderBy(quoted(value).desc_nulls_last(), quoted(tie))
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
