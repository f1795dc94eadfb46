"""Interval algebra: bins, splitting, complements, clipping, intersections, and points in intervals.

Joins between points or intervals and intervals are equi-joins on an entity and a time cell: each interval is laid
into the cells it touches, the exact condition is checked inside, and a pair is taken only in the cell where it begins,
so nothing has to be made distinct afterwards. Long gaps and intervals are expanded block by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions.common import quoted

BLOCK = 4096


def _cells(df: DataFrame, low: Column, high: Column, cell: float, name: str) -> DataFrame:
    """One row for each cell from ``low`` to ``high``, in two steps so that no array gets long."""
    first, last = F.floor(low / cell), F.floor(high / cell)
    df = df.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((last - first) / BLOCK))))
    start = first + F.col("__block") * BLOCK
    return df.withColumn(name, F.explode(F.sequence(start, F.least(start + BLOCK - 1, last)))).drop("__block")


def bin_layout(df: DataFrame, keys: list[str], length: str, size: float, *, least_rest: float = 0.5) -> DataFrame:
    """Bins (keys, bin_no, low, high) of ``size`` that cover 0..length, half-open.

    A rest shorter than ``least_rest`` bins is absorbed by the last bin, a longer one is a bin of its own; a length
    under one bin is one bin. Null or non-positive lengths have none.
    """
    n = quoted(length)
    whole, rest = F.floor(n / size), n % size
    count = F.greatest(F.when(rest < size * least_rest, whole).otherwise(F.ceil(n / size)), F.lit(1)).cast("bigint")
    rows = df.where(n > 0).withColumn("__count", count).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__count") - 1) / BLOCK))))
    low = F.col("__block") * BLOCK
    rows = rows.withColumn("bin_no", F.explode(F.sequence(low, F.least(low + BLOCK - 1, F.col("__count") - 1))))
    high = F.when(F.col("bin_no") == F.col("__count") - 1, n).otherwise((F.col("bin_no") + 1) * size)
    return rows.select(*map(quoted, keys), "bin_no", (F.col("bin_no") * size).alias("low"), high.alias("high"))


def bin_of(position: Column, size: float, bins: Column) -> Column:
    """Number of the bin that holds a position in a :func:`bin_layout` of ``bins`` bins."""
    return F.least(F.floor(position / size), bins - 1)


def split_at_bins(df: DataFrame, start: str, end: str, size: float) -> DataFrame:
    """Split half-open intervals at multiples of ``size``; adds ``bin_no`` and replaces both bounds. Empty ones are dropped."""
    low, high = quoted(start), quoted(end)
    rows = _cells(df.where(low < high), low, high, size, "bin_no").where(F.col("bin_no") * size < high)
    return rows.withColumns({start: F.greatest(low, F.col("bin_no") * size), end: F.least(high, (F.col("bin_no") + 1) * size)})


def merge_overlaps(df: DataFrame, keys: list[str], start: str, end: str, *, touch: float = 0.0) -> DataFrame:
    """Union of closed intervals (keys, start, end) by a running maximum over each entity.

    For entities whose intervals don't fit one window partition use ``interval_islands.merge_intervals``.
    """
    rows = df.where(quoted(start) <= quoted(end)).groupBy(*map(quoted, keys), quoted(start).alias("__s")).agg(F.max(quoted(end)).alias("__e"))
    w = Window.partitionBy(*map(quoted, keys)).orderBy("__s")
    upto = F.max("__e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((F.col("__s") > upto + touch).cast("int"), F.lit(1))
    marked = rows.withColumn("__begins", begins).withColumn("__island", F.sum("__begins").over(w))
    return marked.groupBy(*map(quoted, keys), "__island").agg(F.min("__s").alias(start), F.max("__e").alias(end)).drop("__island")


def complement(df: DataFrame, bounds: DataFrame, keys: list[str], start: str, end: str, low: str, high: str) -> DataFrame:
    """The parts of [low, high] of ``bounds`` (one row an entity) that the disjoint intervals of ``df`` leave free.

    Entities without intervals are free as a whole; pieces of no length are dropped; intervals outside don't count.
    """
    limits = bounds.select(*map(quoted, keys), quoted(low).alias("__low"), quoted(high).alias("__high"))
    inside = df.select(*map(quoted, keys), quoted(start).alias("__s"), quoted(end).alias("__e")).join(limits, keys)
    inside = inside.select(*map(quoted, keys), F.greatest("__s", "__low").alias("__s"), F.least("__e", "__high").alias("__e")).where("__s <= __e")
    ends = limits.select(*map(quoted, keys), F.col("__high").alias("__s"), F.lit(None).cast(limits.schema["__high"].dataType).alias("__e"))
    w = Window.partitionBy(*map(quoted, keys)).orderBy("__s", F.col("__e").asc_nulls_last())
    # every free piece lies before an interval's start or before the upper limit
    rows = inside.unionByName(ends).withColumn("__from", F.max("__e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(limits.select(*map(quoted, keys), "__low"), keys).withColumn("__from", F.coalesce("__from", "__low"))
    return rows.where("__from < __s").select(*map(quoted, keys), F.col("__from").alias(start), F.col("__s").alias(end))


def expand_and_clamp(df: DataFrame, start: str, end: str, by: float, low: float | Column, high: float | Column) -> DataFrame:
    """Widen intervals by ``by`` on both sides within [low, high]."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return df.withColumns({start: F.greatest(quoted(start) - by, low), end: F.least(quoted(end) + by, high)})


def separate_borders(df: DataFrame, keys: list[str], start: str, end: str, *, unit: int = 1) -> DataFrame:
    """Where an interval ends on the number on which the next one begins, let it end ``unit`` earlier."""
    w = Window.partitionBy(*map(quoted, keys)).orderBy(quoted(start), quoted(end))
    shared = quoted(end).eqNullSafe(F.lead(quoted(start)).over(w))
    return df.withColumn(end, F.when(shared, quoted(end) - unit).otherwise(quoted(end)))


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, *, cell: float, keep: str = "inside") -> DataFrame:
    """Points inside ("inside") or outside ("outside") all closed intervals of their entity; each point once, repeats kept."""
    wide = _cells(intervals.where(quoted(start) <= quoted(end)), quoted(start), quoted(end), cell, "__cell")
    right = wide.select(*(quoted(k).alias(f"__k{i}") for i, k in enumerate(keys)), quoted(start).alias("__s"), quoted(end).alias("__e"), "__cell")
    own = points.withColumn("__at_cell", F.floor(quoted(at) / cell))
    within = (F.col("__at_cell") == F.col("__cell")) & quoted(at).between(F.col("__s"), F.col("__e"))
    for i, k in enumerate(keys):
        within = within & (quoted(k) == F.col(f"__k{i}"))
    return own.join(right, within, {"inside": "left_semi", "outside": "left_anti"}[keep]).drop("__at_cell")


def intersect_intervals(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, *, cell: float) -> DataFrame:
    """Pairwise overlaps (keys, start, end) of two lists of closed intervals; a common point is an overlap."""
    a = _cells(left.select(*map(quoted, keys), quoted(start).alias("__s1"), quoted(end).alias("__e1")).where("__s1 <= __e1"), F.col("__s1"), F.col("__e1"), cell, "__cell")
    b = _cells(right.select(*map(quoted, keys), quoted(start).alias("__s2"), quoted(end).alias("__e2")).where("__s2 <= __e2"), F.col("__s2"), F.col("__e2"), cell, "__cell")
    low, high = F.greatest("__s1", "__s2"), F.least("__e1", "__e2")
    both = a.join(b, [*keys, "__cell"]).where((low <= high) & (F.floor(low / cell) == F.col("__cell")))
    return both.select(*map(quoted, keys), low.alias(start), high.alias(end))


def join_points(intervals: DataFrame, points: DataFrame, keys: list[str], at: str, start: str, end: str, *, cell: float) -> DataFrame:
    """All (interval, point) pairs with the point in the closed interval; ``at`` and other columns of both tables are kept."""
    wide = _cells(intervals.where(quoted(start) <= quoted(end)), quoted(start), quoted(end), cell, "__cell")
    return wide.join(points.withColumn("__cell", F.floor(quoted(at) / cell)), [*keys, "__cell"]).where(quoted(at).between(quoted(start), quoted(end))).drop("__cell")


def mark_for_moving(df: DataFrame, start: str, end: str, bin_low: str, bin_high: str, is_first: Column, is_last: Column, least: float) -> DataFrame:
    """Mark pieces shorter than ``least``: they move "left" or "right", by the half of their bin they lie in.

    In the first bin all move right and in the last one all move left; a short piece in the outer half of the first or
    last bin is marked "drop"; long pieces "stay".
    """
    middle = (quoted(bin_low) + quoted(bin_high)) / 2
    in_left = (quoted(start) + quoted(end)) / 2 < middle
    short = quoted(end) - quoted(start) < least
    move = (
        F.when(~short, "stay")
        .when(is_first & in_left | is_last & ~in_left, "drop")
        .when(is_first, "right")
        .when(is_last, "left")
        .when(in_left, "left")
        .otherwise("right")
    )
    return df.withColumn("move", move)


def merge_moving(df: DataFrame, keys: list[str], start: str, end: str, least: float, move: str = "move", *, join_short: bool = False) -> DataFrame:
    """Join moving pieces that share a border if they are together at least ``least`` long; the joined piece stays.

    Returns keys, start, end and move; pieces that don't reach the length are kept as they are. With ``join_short`` they
    are joined two by two instead: a pair under the length moves as one piece where its longer half, of equal ones the
    first, was to move. Dropped pieces are removed.
    """
    w = Window.partitionBy(*map(quoted, keys)).orderBy(quoted(start))
    length = quoted(end) - quoted(start)
    rows = df.where(quoted(move) != "drop").withColumn("__moves", quoted(move) != "stay")
    touches = quoted(start).eqNullSafe(F.lag(quoted(end)).over(w)) & F.col("__moves") & F.coalesce(F.lag("__moves").over(w), F.lit(False))
    rows = rows.withColumn("__new", (~touches).cast("int")).withColumn("__chain", F.sum("__new").over(w))
    chained = [*map(quoted, keys), F.col("__chain")]
    if join_short:
        rows = rows.withColumn("__pair", F.floor((F.row_number().over(Window.partitionBy(*chained).orderBy(quoted(start))) - 1) / 2))
        chained.append(F.col("__pair"))
    chain = Window.partitionBy(*chained)
    long = F.sum(length).over(chain) >= least
    joined = F.col("__moves") & (F.count("*").over(chain) > 1) & (F.lit(True) if join_short else long)
    moves = F.when(long, "stay").otherwise(F.min(F.struct(-length, quoted(start), quoted(move).alias("__move"))).over(chain)["__move"])
    rows = rows.withColumns({"__joined": joined, "__moves_to": moves, "__low": F.min(quoted(start)).over(chain), "__high": F.max(quoted(end)).over(chain)})
    rows = rows.where(~F.col("__joined") | (quoted(start) == F.col("__low")))
    return rows.select(
        *map(quoted, keys),
        quoted(start),
        F.when(F.col("__joined"), F.col("__high")).otherwise(quoted(end)).alias(end),
        F.when(F.col("__joined"), F.col("__moves_to")).otherwise(quoted(move)).alias(move),
    )


def clip_intervals(df: DataFrame, pieces: DataFrame, keys: list[str], start: str, end: str, low: str, high: str, *, cell: float) -> DataFrame:
    """The parts of closed intervals inside pieces [low, high] of their entity, counted from the piece's ``low``; other columns of ``pieces`` are kept."""
    a = _cells(df.select(*map(quoted, keys), quoted(start).alias("__s"), quoted(end).alias("__e")).where("__s <= __e"), F.col("__s"), F.col("__e"), cell, "__cell")
    b = _cells(pieces.where(quoted(low) <= quoted(high)), quoted(low), quoted(high), cell, "__cell")
    first, last = F.greatest("__s", quoted(low)), F.least("__e", quoted(high))
    both = b.join(a, [*keys, "__cell"]).where((first <= last) & (F.floor(first / cell) == F.col("__cell")))
    return both.withColumns({start: first - quoted(low), end: last - quoted(low)}).drop("__s", "__e", "__cell")


def assign_moved(df: DataFrame, keys: list[str], order: str, move: str = "move") -> DataFrame:
    """Number the final bins: staying pieces count up, left movers join the one before, right movers the one after.

    Movers without a staying piece on their side get null; dropped pieces are removed.
    """
    w = Window.partitionBy(*map(quoted, keys)).orderBy(quoted(order)).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.where(quoted(move) != "drop").withColumn("__stays", F.sum((quoted(move) == "stay").cast("int")).over(w))
    total = F.sum((quoted(move) == "stay").cast("int")).over(Window.partitionBy(*map(quoted, keys)))
    number = F.when(quoted(move) == "right", F.col("__stays")).otherwise(F.col("__stays") - 1)
    valid = number.between(0, total - 1)
    return rows.withColumn("final_bin", F.when(valid, number)).drop("__stays")


def overlap_agreement(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, *, cell: float) -> DataFrame:
    """Agreement of two lists of disjoint intervals by entity: total lengths, shared length and their Jaccard ratio."""
    total = lambda df, name: df.groupBy(*map(quoted, keys)).agg(F.sum(quoted(end) - quoted(start)).alias(name))
    shared = intersect_intervals(left, right, keys, start, end, cell=cell).groupBy(*map(quoted, keys)).agg(F.sum(quoted(end) - quoted(start)).alias("shared"))
    both = total(left, "left_total").join(total(right, "right_total"), keys, "full").join(shared, keys, "left")
    both = both.fillna(0, ["left_total", "right_total", "shared"])
    return both.withColumn("jaccard", F.try_divide(F.col("shared"), F.col("left_total") + F.col("right_total") - F.col("shared")))
