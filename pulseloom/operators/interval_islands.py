"""Merging overlapping intervals into periods, and the gaps between these.

All intervals are sorted by entity and start over the whole cluster, so a busy entity is spread over many sorted
parts. A first pass summarises each part: its first and last entity and the last island of the latter. Combining these
few summaries in order gives the island that is open where each part begins; a second pass walks through the parts with
that state and closes every island where it ends. A part holds its state only, never an entity.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulseloom.functions.common import cut, quoted

PERIOD, GAP = "period", "gap"
#: End of no interval; lower than any bound.
NOTHING = -(2**62)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """The batches of each sorted part; a task may hold several parts, or one whose number isn't its own."""

    def pieces() -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part").to_numpy()
                starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                for low, high in zip(starts, [*starts[1:], len(part)], strict=True):
                    yield int(part[low]), batch.slice(low, high - low)

    for part, own in groupby(pieces(), key=itemgetter(0)):
        yield part, map(itemgetter(1), own)


def _entities(batch: pa.RecordBatch, names: list[str], last: tuple | None) -> np.ndarray:
    """True where a row's entity differs from that of the row before; nulls are equal."""
    n = batch.num_rows
    changed = np.zeros(n, bool)
    for name in names:
        a, b = batch.column(name).slice(1), batch.column(name).slice(0, n - 1)
        differs = pc.fill_null(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b)))
        changed[1:] |= differs.to_numpy(zero_copy_only=False)
    changed[0] = last is None or _key(batch, names, 0) != last
    return changed


def _key(batch: pa.RecordBatch, names: list[str], row: int) -> tuple:
    return tuple(batch.column(name)[row].as_py() for name in names)


def _ends_before(changed: np.ndarray, end: np.ndarray, carried: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the largest end so far of its entity without the row, ``NOTHING`` at first; and with the row."""
    group = np.cumsum(changed)
    order = np.argsort(end, kind="stable")
    rank = np.empty(len(end), np.int64)
    rank[order] = np.arange(len(end))  # ranks are far smaller than ends, so group * n + rank is exact
    best = np.maximum.accumulate(group * len(end) + rank)
    with_row = end[order][best - group * len(end)]
    if not changed[0]:
        with_row = np.where(group == 0, np.maximum(with_row, carried), with_row)
    before = np.empty(len(end), np.int64)
    before[0] = carried if not changed[0] else NOTHING
    before[1:] = np.where(changed[1:], NOTHING, with_row[:-1])
    return before, with_row


def _summaries(batches: Iterator[pa.RecordBatch], names: list[str], touch: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for part, own in _by_part(batches):
        row = [part, *_summary(own, names, touch)]
        yield pa.record_batch([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)


def _summary(batches: Iterator[pa.RecordBatch], names: list[str], touch: float) -> list:
    first = last = None
    several, start, end = False, None, NOTHING
    for batch in batches:
        changed = _entities(batch, names, last)
        low, high = batch.column("low").to_numpy(), batch.column("high").to_numpy()
        before, with_row = _ends_before(changed, high, end)
        opens = changed | (low > before + touch)
        if first is None:
            first = _key(batch, names, 0)
        elif changed[0]:
            several = True
        several |= bool(changed[1:].any())
        if opens.any():
            start = int(low[np.flatnonzero(opens)[-1]])
        end, last = with_row[-1], _key(batch, names, batch.num_rows - 1)
    return [several, start, int(end), *first, *last]


def _closed(batches: Iterator[pa.RecordBatch], names: list[str], touch: int, states: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for part, own in _by_part(batches):
        yield from _closed_part(own, names, touch, states[part], schema)


def _closed_part(batches: Iterator[pa.RecordBatch], names: list[str], touch: int, state: tuple, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    entity, start, end, goes_on = state
    for batch in batches:
        changed = _entities(batch, names, entity)
        low, high = batch.column("low").to_numpy(), batch.column("high").to_numpy()
        before, with_row = _ends_before(changed, high, end)
        at = np.flatnonzero(changed | (low > before + touch))
        if len(at):
            # the island that a row closes began at the opening row before, or in an earlier batch or part; it ends at the
            # largest end up to the row before, which rows of this batch may have set too
            begin = np.r_[start if start is not None else 0, low[at[:-1]]].astype(np.int64)
            until = np.r_[with_row[at[0] - 1] if at[0] else end, with_row[at[1:] - 1]].astype(np.int64)
            closes = np.ones(len(at), bool)
            closes[0] = entity is not None
            owner = np.maximum(at - 1, 0)
            keys = [batch.column(name).take(pa.array(owner)) for name in names]
            if closes[0] and at[0] == 0:
                keys = [pa.concat_arrays([pa.array([entity[i]], k.type), k.slice(1)]) for i, k in enumerate(keys)]
            gap = closes & ~changed[at] & (low[at] > until + 1)
            yield from _rows(keys, closes, PERIOD, begin, until, schema)
            yield from _rows(keys, gap, GAP, until + 1, low[at] - 1, schema)
            start = int(low[at[-1]])
        end, entity = with_row[-1], _key(batch, names, batch.num_rows - 1)
    if not goes_on:
        keys = [pa.array([x], schema.field(i).type) for i, x in enumerate(entity)]
        yield from _rows(keys, np.array([True]), PERIOD, np.array([start]), np.array([int(end)]), schema)


def _rows(keys: list[pa.Array], use: np.ndarray, kind: str, low: np.ndarray, high: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if use.any():
        mask = pa.array(use)
        yield pa.record_batch([*(k.filter(mask) for k in keys), pa.array([kind] * int(use.sum())), pa.array(low[use], pa.int64()), pa.array(high[use], pa.int64())], schema=schema)


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, *, touch: int = 1) -> DataFrame:
    """Rows (keys, kind, start, end): the periods that an entity's intervals cover, and the gaps between neighbours.

    Bounds are whole numbers above -2**62 and inclusive. :param touch: an interval that begins at most that far behind the end so
    far continues the period: 1 joins intervals that follow on the next number, 0 those that share one, -1 those that
    share two. Of intervals with the same start the longest stands for all. A gap holds at least one number.

    Defined cases: exchanged bounds are put right; a missing bound: the row does not count; null keys are an entity of
    their own; nested and repeated intervals change nothing; an empty table gives no rows; other columns are ignored.
    """
    names = [f"k{i}" for i in range(len(keys))]
    low, high = F.least(quoted(start), quoted(end)).cast("bigint"), F.greatest(quoted(start), quoted(end)).cast("bigint")
    rows = df.where(quoted(start).isNotNull() & quoted(end).isNotNull()).select(*(quoted(k).alias(a) for k, a in zip(keys, names, strict=True)), low.alias("low"), high.alias("high"))
    longest = rows.groupBy(*names, "low").agg(F.max("high").alias("high"))  # repeated starts never pile up in one part
    laid = cut(longest.repartitionByRange(*names, "low").sortWithinPartitions(*names, "low").withColumn("part", F.spark_partition_id()))

    own = laid.select(*names).schema.fields
    twice = [T.StructField(f"{side}_{f.name}", f.dataType) for side in ("first", "last") for f in own]
    summary = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("several", T.BooleanType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), *twice])
    arrow = to_arrow_schema(summary)
    parts = sorted(laid.mapInArrow(lambda batches: _summaries(batches, names, touch, arrow), summary).collect(), key=lambda r: r["part"])  # one row a part

    states, state = {}, (None, None, NOTHING)
    for i, row in enumerate(parts):
        first, last = tuple(row)[4 : 4 + len(names)], tuple(row)[4 + len(names) :]
        following = tuple(parts[i + 1])[4 : 4 + len(names)] if i + 1 < len(parts) else None
        # an entity that ends with its part is closed there
        states[row["part"]] = (*(state if state[0] == first else (None, None, NOTHING)), following == last)
        if not row["several"] and state[0] == first and row["start"] <= state[2] + touch:
            state = (last, state[1], max(state[2], row["end"]))
        else:
            state = (last, row["start"], row["end"])

    schema = T.StructType([*own, T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out = to_arrow_schema(schema)
    found = laid.mapInArrow(lambda batches: _closed(batches, names, touch, states, out), schema)
    return found.withColumnsRenamed(dict(zip(names, keys, strict=True)))
