"""Percentiles of very large columns from mergeable sketches with a proven rank error.

A sketch is a set of sorted buffers of ``size`` values; a buffer of level l stands for ``fan ** l`` values each. When
``fan`` buffers of one level exist they are collapsed into one of the next level: their values are merged and every
``fan``-th one, from the middle of each stretch, is kept. That moves no rank by more than half the new weight, so the
sum of these halves bounds the error of any percentile; it is carried with the sketch. All buffers are formed by a
fixed rule and the tree has ``log(n / size) / log(fan)`` levels, so the bound is at most about
``levels / (2 * size)`` of n. Sketches are ordinary rows, one for each buffer, and those of different partitions,
recordings or days are combined by collapsing them together.

A task feeds each value into the buffers of all groupings asked for at once, so that of a coarse group, however large,
it hands on a few buffers a level. Groups with many buffers are combined in rounds, each in as many parts as it has
buffers for; the number of rounds grows with the logarithm of their number.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulseloom.functions.common import broadcast_if_small, cut, quoted

SIZE = 2048
FAN = 16
#: Values that a task holds over all its groups, in full buffers or waiting, before it hands on what it has.
TASK_VALUES = 4_000_000
#: Buffers of one group that one task combines; a group with more is combined in parts first.
PART_BUFFERS = 4096

_NAN = float("nan")


def _label(column: pa.Array) -> list:
    """Key values; every NaN is the same object, so that keys with NaN are equal."""
    return [_NAN if x != x else x for x in column.to_pylist()]


class Buffers:
    """The buffers of one group, by level; single values wait until they fill a buffer of level 0."""

    def __init__(self, size: int, fan: int) -> None:
        self.size, self.fan, self.error = size, fan, 0
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self.full: dict[int, list[np.ndarray]] = defaultdict(list)

    def add_values(self, values: np.ndarray) -> None:
        self.waiting.append(values)
        self.n_waiting += len(values)
        if self.n_waiting >= self.size:
            flat = np.concatenate(self.waiting)
            whole = len(flat) // self.size * self.size
            for part in flat[:whole].reshape(-1, self.size):
                self.add_buffer(0, np.sort(part))
            self.waiting, self.n_waiting = [flat[whole:]], len(flat) - whole

    def add_buffer(self, level: int, buffer: np.ndarray) -> None:
        same = self.full[level]
        same.append(buffer)
        if len(same) == self.fan:
            merged = np.sort(np.concatenate(same), kind="stable")
            self.error += self.fan // 2 * self.fan**level
            self.full[level] = []
            self.add_buffer(level + 1, merged[self.fan // 2 :: self.fan])

    @property
    def held(self) -> int:
        return self.n_waiting + self.size * sum(map(len, self.full.values()))

    def rows(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(level, error, values) of each buffer; level -1 holds single values. The error stands on one row."""
        error = self.error
        for level in sorted(self.full):
            for buffer in self.full[level]:
                yield level, error, buffer
                error = 0
        if self.n_waiting:
            yield -1, error, np.sort(np.concatenate(self.waiting))


def _schema(df: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType(
        [T.StructField(k, df.schema[k].dataType) for k in keys]
        + [T.StructField("level", T.IntegerType()), T.StructField("error", T.LongType()), T.StructField("values", T.ArrayType(T.DoubleType()))]
    )


def _out(groups: dict[tuple, Buffers], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held = 0
    for key, buffers in groups.items():
        for level, error, values in buffers.rows():
            rows.append((*key, level, error, values))
            held += len(values)
        if held > 500_000:
            yield _batch(rows, schema)
            rows, held = [], 0
    if rows:
        yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    sizes = np.cumsum([0, *map(len, columns[-1])]).astype(np.int32)
    arrays = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(columns[-1])))
    return pa.record_batch([pa.array(c, schema.field(i).type) for i, c in enumerate(columns[:-1])] + [arrays.cast(schema.field("values").type)], schema=schema)


def _codes(batch: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, list[list]]:
    """A number for each row's key, and the labels of each key column from which it is made."""
    codes, parts = np.zeros(batch.num_rows, np.int64), []
    for name in names:
        coded = batch.column(name).dictionary_encode(null_encoding="encode")
        parts.append(_label(coded.dictionary))
        codes = codes * len(parts[-1]) + coded.indices.to_numpy(zero_copy_only=False)
    return codes, parts


def build_sketches(df: DataFrame, keys: list[str], value: str, *, size: int = SIZE, fan: int = FAN) -> DataFrame:
    """Sketches of ``value`` by ``keys`` as rows (keys, level, error, values); no shuffle.

    Each task sketches its own partition, so a group has rows of many tasks until :func:`merge_sketches`.
    Null and NaN values are not counted; infinite ones are; null keys are a group of their own,
    and so are NaN keys.
    """
    return build_rollups(df, {"": keys}, value, size=size, fan=fan).drop("kind")


def build_rollups(df: DataFrame, groupings: dict[str, list[str]], value: str, *, size: int = SIZE, fan: int = FAN) -> DataFrame:
    """Sketches of ``value`` for several groupings in one pass: rows (kind, all key columns, level, error, values); no shuffle.

    ``kind`` is the grouping's name; key columns that it doesn't use are null. Values and keys as in :func:`build_sketches`.
    """
    keys = list(dict.fromkeys(k for own in groupings.values() for k in own))
    named = [f"k{i}" for i in range(len(keys))]
    used = [(kind, [keys.index(k) for k in own]) for kind, own in groupings.items()]
    number = quoted(value).cast("double")
    rows = df.where(number.isNotNull() & ~F.isnan(number)).select(F.lit("").alias("kind"), *(quoted(k).alias(a) for k, a in zip(keys, named, strict=True)), number.alias("v"))
    schema = _schema(rows, ["kind", *named])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, Buffers] = {}
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            every = batch.column("v").to_numpy(zero_copy_only=False)
            for kind, which in used:
                codes, parts = _codes(batch, [named[i] for i in which])
                order = np.argsort(codes, kind="stable")
                codes, values = codes[order], every[order]
                starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
                for a, b in zip(starts, [*starts[1:], len(values)], strict=True):
                    key: list = [None] * len(named)
                    code = int(codes[a])
                    for i, labels in zip(reversed(which), reversed(parts), strict=True):
                        code, at = divmod(code, len(labels))
                        key[i] = labels[at]
                    got = groups.setdefault((kind, *key), Buffers(size, fan))
                    held -= got.held
                    got.add_values(values[a:b])
                    held += got.held
            if held > TASK_VALUES:
                yield from _out(groups, arrow)
                groups, held = {}, 0
        yield from _out(groups, arrow)

    return rows.mapInArrow(run, schema).withColumnsRenamed(dict(zip(named, keys, strict=True)))


def _groups(batches: Iterator[pa.RecordBatch], named: list[str], size: int, fan: int) -> Iterator[tuple[tuple, Buffers]]:
    """Each key with its buffers combined, from rows sorted by key; only one group is held."""
    key, buffers = None, None
    for batch in batches:
        own = list(zip(*(_label(batch.column(a)) for a in named), strict=True)) if named else [()] * batch.num_rows
        levels, errors = batch.column("level").to_pylist(), batch.column("error").to_pylist()
        lists = batch.column("values")
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        for i, k in enumerate(own):
            if buffers is None or k != key:
                if buffers is not None:
                    yield key, buffers
                key, buffers = k, Buffers(size, fan)
            values = flat[offsets[i] : offsets[i + 1]].copy()
            buffers.error += errors[i]
            if levels[i] < 0:
                buffers.add_values(values)
            else:
                buffers.add_buffer(levels[i], values)
    if buffers is not None:
        yield key, buffers


def _combine(laid: DataFrame, named: list[str], size: int, fan: int) -> DataFrame:
    """One sketch for each key that a task has."""
    schema = _schema(laid, named)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, held = {}, 0
        for key, buffers in _groups(batches, named, size, fan):
            done[key] = buffers
            held += buffers.held
            if held > TASK_VALUES:
                yield from _out(done, arrow)
                done, held = {}, 0
        yield from _out(done, arrow)

    return laid.mapInArrow(run, schema)


def _laid(sketches: DataFrame, keys: list[str], size: int, fan: int, part_buffers: int) -> tuple[DataFrame, list[str]]:
    """The buffers laid out and sorted by key, every group small enough for one task."""
    if part_buffers < 64 * fan:  # a combined part has at most (fan - 1) * levels + 1 buffers, so every round makes fewer
        raise ValueError("part_buffers must be at least 64 * fan")
    named = [f"k{i}" for i in range(len(keys))]
    rows = sketches.select(*(quoted(k).alias(a) for k, a in zip(keys, named, strict=True)), "level", "error", "values")
    order = [*named, "level", F.xxhash64("values")]
    while True:
        rows = cut(rows)
        large = rows.groupBy(*named).agg(F.count("*").alias("n")).where(F.col("n") > part_buffers)
        large = broadcast_if_small(large.select(*(F.col(a).alias(f"g{a}") for a in named), F.ceil(F.col("n") / part_buffers).alias("parts")))
        if large.isEmpty():
            break
        same = F.lit(True)
        for a in named:
            same = same & F.col(a).eqNullSafe(F.col(f"g{a}"))
        part = F.pmod(F.xxhash64("values", "level"), F.coalesce("parts", F.lit(1)))
        rows = rows.join(large, same, "left").withColumn("part", part).select(*named, "part", "level", "error", "values")
        rows = _combine(rows.repartition(*named, "part").sortWithinPartitions("part", *order), [*named, "part"], size, fan).drop("part")
    return (rows.repartition(*named) if named else rows.repartition(1)).sortWithinPartitions(*order), named


def merge_sketches(sketches: DataFrame, keys: list[str], *, size: int = SIZE, fan: int = FAN, part_buffers: int = PART_BUFFERS) -> DataFrame:
    """Combine all sketches that agree in ``keys``, which may be fewer than they were built with.

    A group of more than ``part_buffers`` buffers is first combined in parts of about that many, in rounds until it has
    fewer. A task takes its buffers one by one and holds no more than ``fan`` buffers for each level of the group at hand.
    The sketches are written once, and counted, before they are combined.
    """
    laid, named = _laid(sketches, keys, size, fan, part_buffers)
    return _combine(laid, named, size, fan).withColumnsRenamed(dict(zip(named, keys, strict=True)))


def percentiles(sketches: DataFrame, keys: list[str], ps: list[float], *, size: int = SIZE, fan: int = FAN, part_buffers: int = PART_BUFFERS) -> DataFrame:
    """Rows (keys, p, n, value, rank_error) from sketches, merged or not; they are combined as by :func:`merge_sketches`.

    The value's rank in its group differs from ``p * n`` by at most ``rank_error`` plus one position; 0 means that all
    values were held. A group without values gives no row.
    """
    laid, named = _laid(sketches, keys, size, fan, part_buffers)
    schema = T.StructType(
        [T.StructField(a, laid.schema[a].dataType) for a in named]
        + [T.StructField("p", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("rank_error", T.LongType())]
    )
    arrow = to_arrow_schema(schema)

    def ask(key: tuple, got: list[tuple[int, int, np.ndarray]]) -> list[tuple]:
        values = np.concatenate([v for _, _, v in got])
        weights = np.concatenate([np.full(len(v), fan ** max(level, 0)) for level, _, v in got])
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(weights[order])
        n, error = int(upto[-1]), sum(e for _, e, _ in got)
        top = max(level for level, _, _ in got)
        error += fan**top // 2 if top > 0 else 0
        at = np.minimum(np.searchsorted(upto, np.maximum(1, np.ceil(np.asarray(ps) * n))), len(values) - 1)
        return [(*key, p, n, float(values[order[i]]), error) for p, i in zip(ps, at, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: list[tuple] = []
        for key, buffers in _groups(batches, named, size, fan):
            answers += ask(key, list(buffers.rows()))
            if len(answers) > 50_000:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*answers, strict=True), arrow, strict=True)], schema=arrow)
                answers = []
        if answers:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*answers, strict=True), arrow, strict=True)], schema=arrow)

    return laid.mapInArrow(run, schema).withColumnsRenamed(dict(zip(named, keys, strict=True)))
