"""Moving-frame statistics, smoothing and outlier masks over signals with integer positions.

Frames reach over positions, not rows, so missing samples leave holes instead of shifting the frame. A channel is cut
into stretches of positions with just the overlap that the frame needs; a long channel is therefore many window
partitions, each of bounded size. Frames shrink at a channel's ends. Null, NaN and infinite
samples are skipped.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pulseloom.functions.common import broadcast_if_small, join_summary, quoted

STRETCH = 65_536


def framed(
    df: DataFrame, keys: list[str], position: str, before: int, after: int, add: Callable[[DataFrame, Callable[[int, int], WindowSpec], WindowSpec], DataFrame], *, stretch: int = STRETCH
) -> DataFrame:
    """Apply ``add(rows, frame, order)`` to stretches that overlap by ``before`` and ``after`` positions, and drop the overlap.

    ``frame(a, b)`` is the window from a to b positions away and ``order`` the unframed one; both may look at most
    ``before`` positions back and ``after`` ahead. A stretch is at least as long as the frame.
    """
    stretch = max(stretch, before, after)
    at = quoted(position).cast("bigint")
    own = F.floor(at / stretch)
    copies = F.array_distinct(F.array(F.floor((at - after) / stretch), own, F.floor((at + before) / stretch)))
    laid = df.where(at.isNotNull()).withColumn("__stretch", F.explode(copies))
    order = Window.partitionBy(*map(quoted, keys), "__stretch").orderBy(at)
    done = add(laid, lambda a, b: order.rangeBetween(a, b), order)
    return done.where(F.col("__stretch") == own).drop("__stretch")


def _reach(k: int) -> tuple[int, int]:
    """Positions before and after of a frame of k: an even frame reaches one position further back."""
    return k // 2, (k - 1) // 2


def _number(value: str) -> Column:
    number = quoted(value).cast("double")
    return F.when(F.abs(number) < float("inf"), number)  # NaN counts as larger than infinity


def _total(source: Column, frame: Callable[[int, int], WindowSpec], low: int, high: int, count: bool = False) -> Column:
    """Sum or count over the frame from ``low`` to ``high`` as the difference of two running ones, so its cost doesn't grow with the frame."""
    running = lambda upto: F.coalesce((F.count if count else F.sum)(source).over(frame(Window.unboundedPreceding, upto)), F.lit(0))
    return running(high) - running(low - 1)


def _mean_over(rows: DataFrame, frame: Callable[[int, int], WindowSpec], source: Column, before: int, after: int, out: str) -> DataFrame:
    n = _total(source, frame, -before, after, count=True)
    return rows.withColumn(out, F.when(n > 0, _total(source, frame, -before, after) / n))


def _smooth_over(rows: DataFrame, frame: Callable[[int, int], WindowSpec], source: Column, width: int, passes: int, tolerance: float, out: str) -> DataFrame:
    half, least = width // 2, max(width * (1 - tolerance), 1)
    frames = [(-half, half)] if width % 2 else [(-half, half - 1), (1 - half, half)]
    for _ in range(passes):
        total, weight = (sum((_total(source, frame, *f, count=c) for f in frames), F.lit(0)) / len(frames) for c in (False, True))
        rows = rows.withColumn(out, F.when(weight >= least, total / weight))
        source = F.col(out)
    return rows


def moving_mean(df: DataFrame, keys: list[str], position: str, value: str, k: int, out: str = "moving_mean") -> DataFrame:
    """Mean over a centred frame of ``k`` positions."""
    before, after = _reach(k)
    return framed(df, keys, position, before, after, lambda rows, frame, _: _mean_over(rows, frame, _number(value), before, after, out))


def moving_std(df: DataFrame, keys: list[str], position: str, value: str, k: int, out: str = "moving_std") -> DataFrame:
    """Sample standard deviation over a centred frame of ``k`` positions; null for a single sample."""
    before, after = _reach(k)
    return framed(df, keys, position, before, after, lambda rows, frame, _: rows.withColumn(out, F.stddev_samp(_number(value)).over(frame(-before, after))))


def _std_over(rows: DataFrame, frame: Callable[[int, int], WindowSpec], source: Column, before: int, after: int, out: str) -> DataFrame:
    """Sample deviation from running sums of values and squares; deviations under a millionth of the size of the values come out as 0."""
    n = _total(source, frame, -before, after, count=True)
    one, two = _total(source, frame, -before, after), _total(source * source, frame, -before, after)
    variance = (two - one * one / n) / (n - 1)
    return rows.withColumn(out, F.when(n > 1, F.when(variance > two / n * 1e-12, F.sqrt(variance)).otherwise(0.0)))


def regularity(df: DataFrame, keys: list[str], position: str, value: str, short: int, long: int, out: str = "regularity") -> DataFrame:
    """How steadily a channel varies: the deviation of its short moving deviation over its long one; null where that is 0.

    The cost of a sample doesn't grow with the frames.
    """
    (b1, a1), (b2, a2) = _reach(short), _reach(long)

    def add(rows: DataFrame, frame: Callable[[int, int], WindowSpec], _: WindowSpec) -> DataFrame:
        rows = _std_over(rows, frame, _number(value), b1, a1, "__short")
        rows = _std_over(rows, frame, F.col("__short"), b1, a1, "__twice")
        rows = _std_over(rows, frame, _number(value), b2, a2, "__long")
        return rows.withColumn(out, F.when(F.col("__long") > 0, F.col("__twice") / F.col("__long"))).drop("__short", "__twice", "__long")

    return framed(df, keys, position, max(2 * b1, b2), max(2 * a1, a2), add)


def rising_energy(df: DataFrame, keys: list[str], position: str, value: str, order: int = 3, width: int = 11, out: str = "energy") -> DataFrame:
    """Square of the positive part of the smoothed slope, by least-squares polynomials; null where the frame is not complete."""
    sloped = polynomial_smooth(df, keys, position, value, order, width, derivative=1, out="__slope")
    return sloped.withColumn(out, F.pow(F.greatest(F.col("__slope"), F.lit(0.0)), 2) * F.when(F.col("__slope").isNotNull(), 1)).drop("__slope")


def smooth(df: DataFrame, keys: list[str], position: str, value: str, width: int, passes: int = 3, *, tolerance: float = 0.5, out: str = "smooth") -> DataFrame:
    """Boxcar smoothing, once, twice (triangular) or three times (nearly Gaussian).

    The ends of an even frame weigh one half. A position's result is null where the samples there weigh less than
    ``width * (1 - tolerance)``, at least 1.
    """
    reach = passes * (width // 2)
    return framed(df, keys, position, reach, reach, lambda rows, frame, _: _smooth_over(rows, frame, _number(value), width, passes, tolerance, out))


def smooth_and_level(df: DataFrame, keys: list[str], position: str, value: str, *, smooth_width: int, mean_width: int) -> DataFrame:
    """Add ``smooth`` (three passes of ``smooth_width``) and its moving mean ``level`` over ``mean_width`` in one layout."""
    before, after = _reach(mean_width)
    reach = 3 * (smooth_width // 2)

    def add(rows: DataFrame, frame: Callable[[int, int], WindowSpec], _: WindowSpec) -> DataFrame:
        rows = _smooth_over(rows, frame, _number(value), smooth_width, 3, 0.5, "smooth")
        return _mean_over(rows, frame, F.col("smooth"), before, after, "level")

    return framed(df, keys, position, reach + before, reach + after, add)


def window_sum(df: DataFrame, keys: list[str], position: str, value: str, width: int, out: str = "window_sum") -> DataFrame:
    """Trailing sum of ``width`` positions as a difference of two running sums, whatever the width; null for the first ones.

    Positions must be dense; null samples add nothing.
    """

    def add(rows: DataFrame, _: Callable[[int, int], WindowSpec], order: WindowSpec) -> DataFrame:
        running = F.sum(F.coalesce(_number(value), F.lit(0.0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("__running", running).withColumn("__earlier", F.lag("__running", width, 0.0).over(order))
        return rows.withColumn(out, F.when(quoted(position) >= width - 1, F.col("__running") - F.col("__earlier"))).drop("__running", "__earlier")

    return framed(df, keys, position, width, 0, add)


def rolling_slope(df: DataFrame, keys: list[str], position: str, value: str, steps: int, out: str = "rolling_slope") -> DataFrame:
    """Mean of the next ``steps`` differences; null differences are skipped."""

    def add(rows: DataFrame, frame: Callable[[int, int], WindowSpec], order: WindowSpec) -> DataFrame:
        rows = rows.withColumn("__diff", F.lead(_number(value)).over(order) - _number(value))
        return rows.withColumn(out, F.avg("__diff").over(frame(0, steps - 1))).drop("__diff")

    return framed(df, keys, position, 0, steps + 1, add)


def lagged(df: DataFrame, keys: list[str], position: str, value: str, width: int, out: str = "lagged") -> DataFrame:
    """The sample and those of the ``width - 1`` positions before it as an array, newest first; null samples are kept."""

    def add(rows: DataFrame, _: Callable[[int, int], WindowSpec], order: WindowSpec) -> DataFrame:
        return rows.withColumn(out, F.array(*(F.lag(_number(value), k).over(order) for k in range(width))))

    return framed(df, keys, position, width, 0, add)


def four_point_slope(df: DataFrame, keys: list[str], position: str, value: str, out: str = "slope") -> DataFrame:
    """(2 d0 + 2 d-1 + d-2 + d+1) / 6 over first differences d, where d0 is the step to the next sample; missing ones count 0.

    The last sample of a channel has no step and no result.
    """

    def add(rows: DataFrame, _: Callable[[int, int], WindowSpec], order: WindowSpec) -> DataFrame:
        rows = rows.withColumn("__d", F.lead(_number(value)).over(order) - _number(value))
        near = lambda k: F.coalesce(F.lag("__d", k).over(order) if k > 0 else F.lead("__d", -k).over(order), F.lit(0.0))
        return rows.withColumn(out, (F.col("__d") * 2 + near(1) * 2 + near(2) + near(-1)) / 6).drop("__d")

    return framed(df, keys, position, 3, 3, add)


def polynomial_weights(order: int, width: int, derivative: int = 0) -> list[float]:
    """Weights of the least-squares polynomial's value or derivative in the middle of an odd frame."""
    x = np.arange(width) - width // 2
    basis = np.vander(x, order + 1, increasing=True).astype(float)
    factor = 1.0
    for k in range(2, derivative + 1):
        factor *= k
    return (np.linalg.pinv(basis)[derivative] * factor).tolist()


def polynomial_smooth(df: DataFrame, keys: list[str], position: str, value: str, order: int = 3, width: int = 11, *, derivative: int = 0, out: str = "smooth") -> DataFrame:
    """Least-squares polynomial smoothing with fixed weights; null where the frame is not complete."""
    half, weights = width // 2, polynomial_weights(order, width, derivative)

    def add(rows: DataFrame, _: Callable[[int, int], WindowSpec], window: WindowSpec) -> DataFrame:
        near = lambda k: F.lead(_number(value), k).over(window) if k > 0 else F.lag(_number(value), -k).over(window)
        terms = [near(k - half) * w for k, w in enumerate(weights)]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        return rows.withColumn(out, total)

    return framed(df, keys, position, half, half, add)


def middle_mean_residual(df: DataFrame, keys: list[str], position: str, value: str, half: int, *, low: float = 0.375, high: float = 0.625, out: str = "residual") -> DataFrame:
    """The sample minus the mean of the middle of the sorted frame of ``half`` positions to each side."""

    def add(rows: DataFrame, frame: Callable[[int, int], WindowSpec], _: WindowSpec) -> DataFrame:
        rows = rows.withColumn("__sorted", F.sort_array(F.collect_list(_number(value)).over(frame(-half, half))))
        n = F.size("__sorted")
        first = F.floor(n * low) + 1
        middle = F.slice("__sorted", first.cast("int"), F.greatest(F.ceil(n * high) - first + 1, F.lit(1)).cast("int"))
        mean = F.aggregate(middle, F.lit(0.0), lambda a, x: a + x) / F.size(middle)
        return rows.withColumn(out, F.when(n > 0, _number(value) - mean)).drop("__sorted")

    return framed(df, keys, position, half, half, add)


def fill_with_trailing_median(df: DataFrame, keys: list[str], position: str, value: str, width: int = 20, out: str = "filled") -> DataFrame:
    """Missing samples become the median of the ``width`` positions up to them; null where these are all missing."""

    def add(rows: DataFrame, frame: Callable[[int, int], WindowSpec], _: WindowSpec) -> DataFrame:
        return rows.withColumn(out, F.coalesce(_number(value), F.percentile(_number(value), 0.5).over(frame(1 - width, 0))))

    return framed(df, keys, position, width, 0, add)


def fill_forward(df: DataFrame, keys: list[str], position: str, value: str, *, missing_below: float | None = None, stretch: int = STRETCH, out: str = "filled") -> DataFrame:
    """Missing samples, and those below ``missing_below``, take the last good one, however far back it is.

    The last good sample of each stretch of positions, one row a stretch, is carried over the stretches of its channel.
    Rows without a position are dropped.
    """
    good = F.when(_number(value) >= missing_below, _number(value)) if missing_below is not None else _number(value)
    at = quoted(position).cast("bigint")
    names = [*(f"__k{i}" for i in range(len(keys))), "__stretch"]
    rows = df.where(at.isNotNull()).withColumn("__part", F.floor(at / stretch))
    ends = rows.groupBy(*(quoted(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__part").alias("__stretch")).agg(F.max_by(good, F.when(good.isNotNull(), at)).alias("__last"))
    earlier = Window.partitionBy(*names[:-1]).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*names, F.last("__last", ignorenulls=True).over(earlier).alias("__before")).where("__before is not null")
    same = F.col("__part") == F.col("__stretch")
    for i, k in enumerate(keys):
        same = same & quoted(k).eqNullSafe(F.col(f"__k{i}"))
    joined = rows.join(broadcast_if_small(ends), same, "left").drop(*names)
    inside = Window.partitionBy(*map(quoted, keys), "__part").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, F.coalesce(F.last(good, ignorenulls=True).over(inside), F.col("__before"))).drop("__part", "__before")


def step_outliers(df: DataFrame, keys: list[str], position: str, value: str, multiplier: float, width: int, direction: str = "both", out: str = "outlier") -> DataFrame:
    """Mark both ends of a step that is further than ``multiplier`` standard deviations from the moving mean of the steps.

    The deviation is that of all steps of the entity; the frame is ``width`` steps. Positions must be dense.
    """
    before, after = _reach(width)

    def steps(rows: DataFrame, _: Callable[[int, int], WindowSpec], order: WindowSpec) -> DataFrame:
        return rows.withColumn("__step", F.lead(_number(value)).over(order) - _number(value))

    stepped = framed(df, keys, position, 0, 1, steps)
    spread = stepped.groupBy(*(quoted(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.stddev_samp("__step").alias("__std"))
    same = None
    for i, k in enumerate(keys):
        one = quoted(k).eqNullSafe(F.col(f"__k{i}"))
        same = one if same is None else same & one
    joined = stepped.join(spread, same, "left").drop(*(f"__k{i}" for i in range(len(keys))))

    def mark(rows: DataFrame, frame: Callable[[int, int], WindowSpec], order: WindowSpec) -> DataFrame:
        rows = _mean_over(rows, frame, F.col("__step"), before, after, "__mean")
        off = F.col("__step") - F.col("__mean")
        bound = F.col("__std") * multiplier
        wrong = {"upper": off > bound, "lower": off < -bound, "both": F.abs(off) > bound}[direction]
        rows = rows.withColumn("__wrong", F.coalesce(wrong, F.lit(False)))
        return rows.withColumn(out, F.col("__wrong") | F.coalesce(F.lag("__wrong").over(order), F.lit(False))).drop("__wrong", "__mean")

    return framed(joined, keys, position, before + 2, after + 1, mark).drop("__step", "__std")


def exact_median(df: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """Exact medians by key, in two passes, so that no task holds a key's values.

    Equal values are counted before they are moved. The counts of ranges of values (64 to each doubling) tell in which
    ranges of a key the middle ranks lie; only the values of these are ordered. Null and NaN values don't count; keys
    without values have no row.
    """
    size = F.abs("__v")
    grade = F.floor(F.log2(size) * 64).cast("bigint") + 100_000
    spread = F.when(F.col("__v") == 0, F.lit(0).cast("bigint")).when(size == float("inf"), F.lit(1_000_000).cast("bigint")).otherwise(grade)
    names = [f"__m{i}" for i in range(len(keys))]
    own = df.select(*(quoted(k).alias(a) for k, a in zip(keys, names, strict=True)), value.cast("double").alias("__v"))
    counted = own.where(F.col("__v").isNotNull() & ~F.isnan("__v")).groupBy(*names, "__v").agg(F.count("*").alias("__n"))
    counted = counted.withColumn("__range", F.when(F.col("__v") < 0, -spread).otherwise(spread))
    ranges = counted.groupBy(*names, "__range").agg(F.sum("__n").alias("__in"))
    by = Window.partitionBy(*names)
    ranges = ranges.withColumns({"__upto": F.sum("__in").over(by.orderBy("__range")), "__all": F.sum("__in").over(by)})
    before = F.col("__upto") - F.col("__in")
    low, high = F.floor((F.col("__all") + 1) / 2), F.floor(F.col("__all") / 2) + 1
    middle = ranges.where((F.col("__upto") >= low) & (before < high)).select(*names, "__range", before.alias("__before"), low.alias("__low"), high.alias("__high"))
    held = join_summary(counted, middle, [*names, "__range"]).where("__low is not null")
    inside = Window.partitionBy(*names, "__range").orderBy("__v")
    held = held.withColumn("__rank", F.col("__before") + F.sum("__n").over(inside))
    at = lambda rank: F.max(F.when((F.col("__rank") >= F.col(rank)) & (F.col("__rank") - F.col("__n") < F.col(rank)), F.col("__v")))
    found = held.groupBy(*names).agg(((at("__low") + at("__high")) / 2).alias(out))
    return found.withColumnsRenamed(dict(zip(names, keys, strict=True)))


def mad_outliers(df: DataFrame, keys: list[str], value: str, limit: float = 3.0, out: str = "outlier") -> DataFrame:
    """Mark values further than ``limit`` scaled median absolute deviations from the entity's median; null values are not marked.

    The medians, one row a key, are joined to the rows by a broadcast while they are small.
    """
    with_median = join_summary(df, exact_median(df, keys, _number(value), "__median"), keys)
    spread = exact_median(with_median, keys, F.abs(_number(value) - F.col("__median")), "__mad")
    far = F.abs(_number(value) - F.col("__median")) > F.col("__mad") * 1.4826 * limit
    return join_summary(with_median, spread, keys).withColumn(out, F.coalesce(far, F.lit(False))).drop("__median", "__mad")


def ampogram(df: DataFrame, keys: list[str], position: str, value: str, width: int, *, edges: str = "disjoint", out: str = "height") -> DataFrame:
    """Maximum minus minimum of consecutive windows of ``width`` positions: keys, window_no, n, height.

    With edges="shared" a window also holds the last position of the one before it.
    """
    at = quoted(position).cast("bigint")
    rows = df.where(at.isNotNull())
    if edges == "shared":
        number = F.explode(F.array_distinct(F.array(F.floor(at / width), F.floor((at + 1) / width))))
    else:
        number = F.floor(at / width)
    rows = rows.withColumn("window_no", number)
    return rows.groupBy(*map(quoted, keys), "window_no").agg(F.count(_number(value)).alias("n"), (F.max(_number(value)) - F.min(_number(value))).alias(out))
