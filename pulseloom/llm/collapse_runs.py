"""Collapsing runs of identical or near-identical consecutive events.

Events are laid out by entity and position range. Within a range only boundary rows are kept, those that differ from
their predecessor; ``lead`` over the starts then gives each run's count as a difference of ordinals and its end from
the next start's predecessor. Only the first and last run of a range can go on in another one: those are stitched by
the same step over far fewer rows, so a busy entity never needs all its events in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions.common import latest, quoted


def _collapse(df: DataFrame, group: list[str], continues: Column) -> DataFrame:
    """Runs of rows (start, end, first, last, from_time, to_time, n), each ordered by start within ``group``."""
    order = Window.partitionBy(*group).orderBy("start", "first")
    before = F.struct("end", "last", "to_time", F.col("done").alias("done"))
    marked = (
        df.withColumn("done", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("prev", F.lag(before).over(order))
        .withColumn("prev_range", F.lag("range").over(order))
        .withColumn("final", F.lead("start").over(order).isNull())
        .withColumn("begins", F.col("prev").isNull() | ~continues)
    )
    kept = marked.where("begins or final")
    here = F.struct("end", "last", "to_time", "done")
    following = F.lead(F.when(F.col("begins"), F.col("prev")).otherwise(here)).over(order)
    ends = F.coalesce(following, here)
    return (
        kept.withColumn("until", ends)
        .withColumn("ends_range", F.col("final") | F.lead("final").over(order) & ~F.lead("begins").over(order))
        .where("begins")
        .withColumn("n", F.col("until.done") - F.coalesce(F.col("prev.done"), F.lit(0)))
        .withColumn("edge", F.col("prev").isNull() | F.col("ends_range"))
        .withColumn("end", F.col("until.end"))
        .withColumn("last", F.col("until.last"))
        .withColumn("to_time", F.col("until.to_time"))
        .drop("until", "prev", "prev_range", "final", "begins", "done", "ends_range")
    )


def collapse_runs(
    df: DataFrame,
    keys: list[str],
    position: str,
    value: str,
    *,
    from_time: str | None = None,
    to_time: str | None = None,
    tolerance: float | None = None,
    contiguous: bool = True,
    latest_by: str | None = None,
    range_len: int = 65536,
) -> DataFrame:
    """One row per run: keys, ``value`` (of its first event), ``start``, ``end``, ``n_events`` and ``duration``.

    :param position: integer order of the events of an entity.
    :param from_time, to_time: seconds at which an event begins and ends; ``position`` and ``position + 1`` by default.
    :param tolerance: values that differ by at most that from their predecessor continue its run; equality by default.
    :param contiguous: a missing position ends a run.
    :param latest_by: of several events at one position, keep the one with the largest value of this column.
    :param range_len: positions handled together.

    Defined cases: null values are equal to each other, so are NaNs (with a tolerance too); a null position is no
    event; null keys are an entity of their own; repeated positions (without ``latest_by``) count as events of their
    own, ordered by value; an empty table gives no runs; other columns are ignored.
    """
    as_key = [f"k{i}" for i in range(len(keys))]
    at = quoted(position).cast("bigint")
    begin = quoted(from_time).cast("double") if from_time else at.cast("double")
    finish = quoted(to_time).cast("double") if to_time else (at + 1).cast("double")
    rows = df.where(at.isNotNull()).select(
        *(quoted(k).alias(a) for k, a in zip(keys, as_key, strict=True)),
        F.floor(at / range_len).alias("range"),
        at.alias("start"),
        quoted(value).alias("first"),
        begin.alias("from_time"),
        finish.alias("to_time"),
        *([quoted(latest_by).alias("by")] if latest_by else []),
    )
    if latest_by:
        rows = latest(rows, [*as_key, "range", "start"], "by", partition=[*as_key, "range"]).drop("by")
    rows = rows.withColumns({"end": F.col("start"), "last": F.col("first"), "n": F.lit(1).cast("bigint")})

    same = F.col("first").eqNullSafe(F.col("prev.last"))
    if tolerance is not None:
        same = same | F.coalesce(F.abs(F.col("first") - F.col("prev.last")) <= tolerance, F.lit(False))
    if contiguous:
        same = same & (F.col("start") == F.col("prev.end") + 1)
    within = _collapse(rows, [*as_key, "range"], same)
    place = within.withColumn("place", F.when(~F.col("edge"), F.col("range"))).drop("edge")
    stitched = _collapse(place, [*as_key, "place"], same & F.col("place").isNull() & (F.col("prev_range") < F.col("range")))
    return stitched.select(
        *(F.col(a).alias(k) for k, a in zip(keys, as_key, strict=True)),
        F.col("first").alias(value),
        "start",
        "end",
        F.col("n").alias("n_events"),
        (F.col("to_time") - F.col("from_time")).alias("duration"),
    )
