"""Operators on array channels: a row holds a channel's samples, and its positions are those of the array, from 0.

A channel is cut into chunks that overlap by what a frame needs, by a slice of its array and without a shuffle; long
channels are many chunks. A task computes a chunk with running totals over its samples, so no cost grows with the frame,
and hands on only what was asked for: rows of samples, or a few rows a chunk (runs, totals) that are combined by key.
Null, NaN and infinite samples are skipped; frames shrink at a channel's ends. Null and empty arrays have no rows, null
keys are kept, and other columns are ignored. Rows with equal keys are channels of their own in sample operators; where
results are combined by key they count as one channel, so keys should be unique there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulseloom.functions.common import broadcast_if_small, quoted

#: Samples of a chunk without its overlap; longer frames take longer chunks.
CHUNK = 65_536
#: Rows of an outgoing Arrow batch, about.
OUT_ROWS = 500_000

Found = tuple[np.ndarray, list]


def chunked(df: DataFrame, samples: str, before: int | Column, after: int | Column, *, size: int = CHUNK) -> DataFrame:
    """One row for each chunk of the array column ``samples``, with ``before`` and ``after`` samples more where there are any.

    Adds ``__at`` (position of the chunk's first own sample), ``__lead`` (samples before it) and ``__own`` (own samples).
    """
    before, after = (F.lit(x) if isinstance(x, int) else x.cast("int") for x in (before, after))
    rows = df.where(F.size(quoted(samples)) > 0).withColumns({"__n": F.size(quoted(samples)), "__size": F.greatest(F.lit(size), (before + after) * 4)})
    rows = rows.withColumn("__no", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / F.col("__size")).cast("int"))))
    low = F.col("__no") * F.col("__size")
    rows = rows.withColumns({"__at": low, "__from": F.greatest(low - before, F.lit(0)), "__own": F.least(F.col("__size"), F.col("__n") - low)})
    piece = F.slice(quoted(samples), F.col("__from") + 1, F.col("__at") + F.col("__own") + after - F.col("__from"))
    whole = (F.col("__n") <= F.col("__size")) & (F.col("__from") == 0)
    return rows.withColumns({samples: F.when(whole, quoted(samples)).otherwise(piece), "__lead": F.col("__at") - F.col("__from")}).drop("__n", "__size", "__no", "__from")


def over_chunks(
    chunks: DataFrame, keys: list[str], samples: str, apply: Callable[[np.ndarray, dict], Found], fields: str, *, carry: tuple[str, ...] = (), position: str = "idx", everywhere: bool = False
) -> DataFrame:
    """Rows (keys, position, fields) that ``apply(x, carried)`` finds in each chunk: positions in x, and a column for each field.

    Positions outside the chunk's own samples are dropped and the others counted from the channel's begin, or, with
    ``everywhere``, all are kept as they are. ``carry`` are columns whose values ``apply`` gets by name.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = chunks.select(*(quoted(k).alias(a) for k, a in zip(keys, names, strict=True)), quoted(samples).alias("__x"), "__at", "__lead", "__own", *(quoted(c).alias(f"c{i}") for i, c in enumerate(carry)))
    extra = T._parse_datatype_string(fields)
    schema = T.StructType([*rows.select(*names).schema.fields, T.StructField("__position", T.LongType()), *extra.fields])
    arrow = to_arrow_schema(schema)

    def out(batch: pa.RecordBatch, owner: list, places: list, columns: list) -> pa.RecordBatch:
        at = pa.array(np.repeat([o for o, _ in owner], [n for _, n in owner]))
        values = [pa.array(np.concatenate(c), f.type, from_pandas=True) for c, f in zip(zip(*columns, strict=True), list(arrow)[len(names) + 1 :], strict=True)]
        return pa.record_batch([*(batch.column(a).take(at) for a in names), pa.array(np.concatenate(places), pa.int64()), *values], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("__x")
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(float, copy=False)
            begin, lead, own = (batch.column(c).to_numpy() for c in ("__at", "__lead", "__own"))
            carried = {c: batch.column(f"c{i}").to_pylist() for i, c in enumerate(carry)}
            owner, places, columns, held = [], [], [], 0
            for i in range(batch.num_rows):
                x = flat[offsets[i] : offsets[i + 1]]
                at, found = apply(np.where(np.isfinite(x), x, np.nan), {c: v[i] for c, v in carried.items()})
                if everywhere:
                    where = at
                else:
                    keep = (at >= lead[i]) & (at < lead[i] + own[i])
                    where, found = at[keep] + (int(begin[i]) - int(lead[i])), [c[keep] for c in found]
                if len(where):
                    owner.append((i, len(where)))
                    places.append(where)
                    columns.append(found)
                    held += len(where)
                if held > OUT_ROWS:
                    yield out(batch, owner, places, columns)
                    owner, places, columns, held = [], [], [], 0
            if owner:
                yield out(batch, owner, places, columns)

    return rows.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, keys, strict=True)) | {"__position": position})


# ---- numbers over one chunk


def _bounds(n: int, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(n)
    return np.maximum(at - before, 0), np.minimum(at + after + 1, n)


def _sums(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(x)])
    return upto[high] - upto[low]


def _middle(x: np.ndarray, known: np.ndarray) -> float:
    """A whole number near the mean; without it running totals lose less, and sums that are exact in binary stay so."""
    return float(np.round(x[known].mean())) if known.any() else 0.0


def frame_mean(x: np.ndarray, before: int, after: int) -> np.ndarray:
    """Mean of the known samples of each frame, NaN without any."""
    known = ~np.isnan(x)
    middle = _middle(x, known)
    low, high = _bounds(len(x), before, after)
    n = _sums(known, low, high)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, (_sums(np.where(known, x - middle, 0.0), low, high) + middle * n) / n, np.nan)


def frame_std(x: np.ndarray, before: int, after: int) -> np.ndarray:
    """Sample deviation of each frame; NaN with fewer than two samples, 0 below a millionth of the channel's size."""
    known = ~np.isnan(x)
    centred = np.where(known, x - _middle(x, known), 0.0)
    low, high = _bounds(len(x), before, after)
    n, one, two = _sums(known, low, high), _sums(centred, low, high), _sums(centred * centred, low, high)
    with np.errstate(invalid="ignore", divide="ignore"):
        variance = (two - one * one / n) / (n - 1)
    return np.where(n > 1, np.sqrt(np.where(variance > 1e-14 * (centred * centred).max(initial=0.0), variance, 0.0)), np.nan)


def boxcar(x: np.ndarray, width: int, passes: int, tolerance: float = 0.5) -> np.ndarray:
    """Boxcar smoothing as in :func:`smooth`."""
    half, least = width // 2, max(width * (1 - tolerance), 1)
    frames = [(half, half)] if width % 2 else [(half, half - 1), (half - 1, half)]
    for _ in range(passes):
        known = ~np.isnan(x)
        middle = _middle(x, known)
        centred = np.where(known, x - middle, 0.0)
        bounds = [_bounds(len(x), *f) for f in frames]
        weight = sum(_sums(known, *b) for b in bounds) / len(frames)
        with np.errstate(invalid="ignore", divide="ignore"):
            x = np.where(weight >= least, (sum(_sums(centred, *b) for b in bounds) / len(frames) + middle * weight) / weight, np.nan)
    return x


def first_steps(x: np.ndarray) -> np.ndarray:
    """The step from each sample to the next; NaN at the end and beside missing samples."""
    return np.append(np.diff(x), np.nan)


# ---- sample operators


def _each(df: DataFrame, keys: list[str], samples: str, before: int, after: int, f: Callable[[np.ndarray], np.ndarray], out: str, kind: str = "double") -> DataFrame:
    return over_chunks(chunked(df, samples, before, after), keys, samples, lambda x, _: (np.arange(len(x)), [f(x)]), f"{out} {kind}")


def moving_mean(df: DataFrame, keys: list[str], samples: str, k: int, out: str = "moving_mean") -> DataFrame:
    """Rows (keys, idx, mean) over a centred frame of ``k`` positions; an even frame reaches one position further back."""
    before, after = k // 2, (k - 1) // 2
    return _each(df, keys, samples, before, after, lambda x: frame_mean(x, before, after), out)


def moving_std(df: DataFrame, keys: list[str], samples: str, k: int, out: str = "moving_std") -> DataFrame:
    """Rows (keys, idx, sample deviation) over a centred frame of ``k`` positions; null for a single sample."""
    before, after = k // 2, (k - 1) // 2
    return _each(df, keys, samples, before, after, lambda x: frame_std(x, before, after), out)


def smooth(df: DataFrame, keys: list[str], samples: str, width: int, passes: int = 3, *, tolerance: float = 0.5, out: str = "smooth") -> DataFrame:
    """Boxcar smoothing, once, twice (triangular) or three times (nearly Gaussian).

    The ends of an even frame weigh one half. A position's result is null where the samples there weigh less than
    ``width * (1 - tolerance)``, at least 1.
    """
    reach = passes * (width // 2)
    return _each(df, keys, samples, reach, reach, lambda x: boxcar(x, width, passes, tolerance), out)


def rolling_slope(df: DataFrame, keys: list[str], samples: str, steps: int, out: str = "rolling_slope") -> DataFrame:
    """Mean of the next ``steps`` differences; those beside missing samples are skipped."""
    return _each(df, keys, samples, 0, steps + 1, lambda x: frame_mean(first_steps(x), 0, steps - 1), out)


def middle_mean_residual(df: DataFrame, keys: list[str], samples: str, half: int, *, low: float = 0.375, high: float = 0.625, out: str = "residual") -> DataFrame:
    """The sample minus the mean of the middle of the sorted frame of ``half`` positions to each side."""

    def residual(x: np.ndarray) -> np.ndarray:
        padded = np.pad(x, half, constant_values=np.nan)
        frames = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1)
        mean = np.empty(len(x))
        for start in range(0, len(x), 8192):
            ordered = np.sort(frames[start : start + 8192], axis=1)  # NaN come last
            n = (~np.isnan(ordered)).sum(1)
            first = np.floor(n * low).astype(int)
            last = np.maximum(np.ceil(n * high).astype(int), first + 1)
            upto = np.concatenate([np.zeros((len(ordered), 1)), np.cumsum(np.nan_to_num(ordered), axis=1)], axis=1)
            rows = np.arange(len(ordered))
            mean[start : start + 8192] = np.where(n > 0, (upto[rows, np.minimum(last, 2 * half + 1)] - upto[rows, first]) / (last - first), np.nan)
        return x - mean

    return _each(df, keys, samples, half, half, residual, out)


def fill_with_trailing_median(df: DataFrame, keys: list[str], samples: str, width: int = 20, out: str = "filled") -> DataFrame:
    """Missing samples become the median of the ``width`` positions up to them; null where these are all missing."""

    def fill(x: np.ndarray) -> np.ndarray:
        missing = np.flatnonzero(np.isnan(x))
        if not len(missing):
            return x
        frames = np.lib.stride_tricks.sliding_window_view(np.pad(x, (width - 1, 0), constant_values=np.nan), width)
        done = x.copy()
        for start in range(0, len(missing), 8192):
            some = missing[start : start + 8192]
            own = frames[some]
            some, own = some[~np.isnan(own).all(1)], own[~np.isnan(own).all(1)]
            if len(some):
                done[some] = np.nanmedian(own, axis=1)
        return done

    return _each(df, keys, samples, width, 0, fill, out)


def fill_forward(df: DataFrame, keys: list[str], samples: str, *, missing_below: float | None = None, out: str = "filled") -> DataFrame:
    """Missing samples, and those below ``missing_below``, take the last good one, however far back it is.

    Each chunk's last good sample is one row; carried over the chunks of its channel it fills the next ones' beginnings.
    """

    def good(x: np.ndarray) -> np.ndarray:
        return x if missing_below is None else np.where(x >= missing_below, x, np.nan)

    chunks = chunked(df, samples, 0, 0)

    def last(x: np.ndarray, carried: dict) -> Found:
        known = np.flatnonzero(~np.isnan(good(x)))
        return np.array([carried["__at"]]), [np.array([x[known[-1]] if len(known) else np.nan])]

    def filled(x: np.ndarray, carried: dict) -> Found:
        y = good(x)
        known = np.maximum.accumulate(np.where(np.isnan(y), -1, np.arange(len(y))))
        start = np.nan if carried["__before"] is None else carried["__before"]
        return np.arange(len(x)), [np.where(known >= 0, y[known], start)]

    ends = over_chunks(chunks, keys, samples, last, "__last double", carry=("__at",), position="__at", everywhere=True)
    order = Window.partitionBy(*map(quoted, keys)).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*(quoted(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__at").alias("__chunk"), F.last("__last", ignorenulls=True).over(order.partitionBy(*map(quoted, keys))).alias("__before"))
    ends = ends.where("__before is not null")
    same = F.col("__at") == F.col("__chunk")
    for i, k in enumerate(keys):
        same = same & quoted(k).eqNullSafe(F.col(f"__k{i}"))
    return over_chunks(chunks.join(broadcast_if_small(ends), same, "left"), keys, samples, filled, f"{out} double", carry=("__before",))


def step_outliers(df: DataFrame, keys: list[str], samples: str, multiplier: float, width: int, direction: str = "both") -> DataFrame:
    """Positions (keys, idx) at both ends of a step further than ``multiplier`` standard deviations from the moving mean of the steps.

    The deviation is that of all steps of the key; the frame is ``width`` steps. The deviations, one row a key, come from
    totals of the chunks and go to the chunks by a broadcast while they are small.
    """
    before, after = width // 2, (width - 1) // 2

    def totals(x: np.ndarray, carried: dict) -> Found:
        step = first_steps(x)[: carried["__own"]]
        step = step[~np.isnan(step)]
        return np.zeros(1, int), [np.array([len(step)]), np.array([step.sum()]), np.array([(step * step).sum()])]

    one = chunked(df, samples, 0, 1)
    sums = over_chunks(one, keys, samples, totals, "n long, s double, q double", carry=("__own",), position="__none", everywhere=True)
    spread = sums.groupBy(*(quoted(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    variance = F.greatest((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1), F.lit(0.0))
    spread = spread.where("n > 1").select(*(f"__k{i}" for i in range(len(keys))), (F.sqrt(variance) * multiplier).alias("__bound"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & quoted(k).eqNullSafe(F.col(f"__k{i}"))

    def mark(x: np.ndarray, carried: dict) -> Found:
        step = first_steps(x)
        off = step - frame_mean(step, before, after)
        bound = carried["__bound"]
        with np.errstate(invalid="ignore"):
            wrong = {"upper": off > bound, "lower": off < -bound, "both": np.abs(off) > bound}[direction]
        at = np.flatnonzero(wrong | np.concatenate([[False], wrong[:-1]]))
        return at, []

    chunks = chunked(df, samples, before + 2, after + 2)
    return over_chunks(chunks.join(broadcast_if_small(spread), same), keys, samples, mark, "", carry=("__bound",))


# ---- pulses and beats


def pulse_valleys_and_peaks(df: DataFrame, keys: list[str], samples: str, *, smooth_width: str, mean_width: str) -> DataFrame:
    """Valleys and peaks of pulse waves: extrema of the runs below and above the moving mean of the smoothed signal.

    ``smooth_width`` and ``mean_width`` are columns, so channels of any rates go through one plan. Returns keys, run_no,
    kind, idx, value; equal samples: the earliest. A held signal, which differs from its mean by rounding only, is not above
    it. Runs are formed in the chunks, and only runs are joined by key.
    """
    reach = F.floor(quoted(smooth_width) / 2).cast("int") * 3 + F.floor(quoted(mean_width) / 2).cast("int")

    def runs(x: np.ndarray, carried: dict) -> Found:
        soft = boxcar(x, carried[smooth_width], 3)
        wide = carried[mean_width]
        level = frame_mean(soft, wide // 2, (wide - 1) // 2)
        low = carried["__lead"]
        at = np.flatnonzero(~np.isnan(soft) & ~np.isnan(level) & ~np.isnan(x))
        at = at[(at >= low) & (at < low + carried["__own"])]
        if not len(at):
            return at, [at, at.astype(bool), at.astype(float)]
        up = soft[at] - level[at] > 1e-11 * np.nanmax(np.abs(x))
        begins = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
        signed = np.where(up, x[at], -x[at])
        run = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(at))))
        best = np.lexsort((at, -signed, run))[begins]  # of each run the largest, the earliest of equals
        return at[best], [at[begins] - low + carried["__at"], up[begins], x[at[best]]]

    chunks = chunked(df, samples, reach, reach)
    pieces = over_chunks(chunks, keys, samples, runs, "begin long, up boolean, value double", carry=(smooth_width, mean_width, "__lead", "__own", "__at"))
    w = Window.partitionBy(*map(quoted, keys)).orderBy("begin")
    begins = F.coalesce((F.col("up") != F.lag("up").over(w)).cast("int"), F.lit(1))
    numbered = pieces.withColumn("__begins", begins).withColumn("run_no", F.sum("__begins").over(w))
    best = F.struct(F.when(F.col("up"), F.col("value")).otherwise(-F.col("value")).alias("v"), (-F.col("idx")).alias("p"))
    top = numbered.groupBy(*map(quoted, keys), "run_no", "up").agg(F.max(best).alias("__top"))
    value = F.when(F.col("up"), F.col("__top.v")).otherwise(-F.col("__top.v"))
    return top.select(*map(quoted, keys), "run_no", F.when(F.col("up"), "peak").otherwise("valley").alias("kind"), (-F.col("__top.p")).alias("idx"), value.alias("value"))


def beat_bounds(valleys: DataFrame, keys: list[str], position: str = "idx") -> DataFrame:
    """Beats (keys, beat_no, low, high) between neighbouring distinct valleys, numbered from 0."""
    marks = valleys.where(quoted(position).isNotNull()).select(*map(quoted, keys), quoted(position).cast("bigint").alias("low")).distinct()
    w = Window.partitionBy(*map(quoted, keys)).orderBy("low")
    return marks.withColumns({"beat_no": (F.row_number().over(w) - 1).cast("int"), "high": F.lead("low").over(w)}).where("high is not null")


def over_beats(df: DataFrame, bounds: DataFrame, keys: list[str], samples: str, measure: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict], fields: str, *, carry: tuple[str, ...] = (), size: int = CHUNK) -> DataFrame:
    """One row (keys, carry, beat_no, low, high, fields) for each beat: ``measure(value, offset, n, which)`` of matrices with a row a beat.

    ``value`` and ``offset`` hold the known samples of the beats from their first bound to their last, ``n`` of each, NaN
    behind; ``which`` are the rows' numbers among the chunk's beats. Beats are listed by the chunk in which they begin, and
    each list meets the slice of the channel that its beats cover, so that samples are moved at most once.
    """
    names = [f"k{i}" for i in range(len(keys))]
    lists = bounds.groupBy(*(quoted(k).alias(a) for k, a in zip(keys, names, strict=True)), F.floor(F.col("low") / size)).agg(
        F.min("low").alias("__from"), F.max("high").alias("__to"), F.sort_array(F.collect_list(F.struct("beat_no", "low", "high"))).alias("__b")
    )
    lists = lists.select(*names, "__from", "__to", *(F.col("__b")[c].alias(f"__{c}") for c in ("beat_no", "low", "high")))
    same = F.lit(True)
    for k, a in zip(keys, names, strict=True):
        same = same & quoted(k).eqNullSafe(F.col(a))
    own = df.where(F.size(quoted(samples)) > 0).select(*map(quoted, keys), *(quoted(c).alias(f"c{i}") for i, c in enumerate(carry)), quoted(samples).alias("__x"))
    rows = own.join(broadcast_if_small(lists), same).drop(*keys)
    rows = rows.withColumn("__x", F.slice("__x", (F.col("__from") + 1).cast("int"), (F.col("__to") - F.col("__from") + 1).cast("int")))
    carried = [f"c{i}" for i in range(len(carry))]
    extra = T._parse_datatype_string(fields)
    schema = T.StructType([*rows.select(*names, *carried).schema.fields, T.StructField("beat_no", T.IntegerType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), *extra.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.column("__x")[i].values.to_numpy(zero_copy_only=False).astype(float, copy=False)
                number, low, high = (batch.column(f"__{c}")[i].values.to_numpy() for c in ("beat_no", "low", "high"))
                start = batch.column("__from")[i].as_py()
                for which, value, offset, n in _matrices(x, low - start, high - start):
                    found = measure(value, offset, n, which)
                    if len(which):
                        at = pa.array(np.full(len(which), i))
                        columns = [pa.array(found[f.name], arrow.field(f.name).type, from_pandas=True) for f in extra.fields]
                        made = pa.record_batch([*(batch.column(a).take(at) for a in [*names, *carried]), pa.array(number[which], pa.int32()), pa.array(low[which]), pa.array(high[which]), *columns], schema=arrow)
                        yield made.filter(pa.array(found["keep"])) if "keep" in found else made

    return rows.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, keys, strict=True)) | {f"c{i}": c for i, c in enumerate(carry)})


def _matrices(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The known samples and offsets of beats [low, high] as matrices, beats of like length together."""
    known = np.flatnonzero(np.isfinite(x))
    first, last = np.searchsorted(known, low), np.searchsorted(known, high, "right")
    n = last - first
    group = np.ceil(np.log2(np.maximum(n, 1))).astype(int)
    for g in np.unique(group[n > 0]):
        which = np.flatnonzero((group == g) & (n > 0))
        width = int(n[which].max())
        inside = np.arange(width) < n[which, None]
        at = known[np.minimum(first[which, None] + np.arange(width), len(known) - 1)]
        yield which, np.where(inside, x[at], np.nan), np.where(inside, at - low[which, None], np.nan), n[which]


def _best(score: np.ndarray, offset: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Offset of each row's largest score where ``keep``, the earliest of equals; NaN where there is none."""
    masked = np.where(keep & ~np.isnan(score), score, -np.inf)
    at = masked.argmax(1)
    rows = np.arange(len(score))
    return np.where(np.isneginf(masked[rows, at]), np.nan, offset[rows, at])


def _value_at(value: np.ndarray, offset: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The value at each row's offset ``at``, NaN without one."""
    hit = offset == at[:, None]
    rows = np.arange(len(value))
    return np.where(hit.any(1), value[rows, hit.argmax(1)], np.nan)


def _shape(value: np.ndarray, offset: np.ndarray, n: np.ndarray, levels: tuple[int, ...]) -> dict:
    rows = np.arange(len(n))
    first_v, last_v, first_o, last_o = value[:, 0], value[rows, n - 1], offset[:, 0], offset[rows, n - 1]
    top = np.nanmax(value, axis=1)
    peak = _best(value, offset, np.ones_like(value, bool))
    low = np.nanmin(value, axis=1)
    gone = np.full((len(n), 1), np.nan)
    next_v, next_o = np.hstack([value[:, 1:], gone]), np.hstack([offset[:, 1:], gone])
    width = next_o - offset
    slope = (next_v - value) / width
    off = value - (first_v[:, None] + (last_v - first_v)[:, None] * (offset - first_o[:, None]) / (last_o - first_o)[:, None])
    next_off = np.hstack([off[:, 1:], gone])
    rising, falling = next_o <= peak[:, None], offset >= peak[:, None]
    found = {
        "n_samples": n,
        "begin_value": first_v,
        "end_value": last_v,
        "peak_offset": peak,
        "peak_value": top,
        "rise_offset": _best(slope, offset, rising),
        "fall_offset": _best(-slope, offset, falling),
        "least_value": low,
        "area": np.nancumsum((value - low[:, None] + (next_v - low[:, None])) / 2 * width, axis=1)[:, -1],
        "area_over_line": np.nancumsum((np.abs(off) + np.abs(next_off)) / 2 * width, axis=1)[:, -1],
        "peak_over_line": _value_at(off, offset, peak),
    }
    heights = {str(p): first_v + (top - first_v) * (p / 100) for p in levels} | {f"end_{p}": last_v + (top - last_v) * ((100 - p) / 100) for p in levels}
    for name, height in heights.items():
        level = height[:, None]
        cross = offset + (level - value) / slope
        up = np.where(rising & (value < level) & (next_v >= level), cross, -np.inf).max(1)
        down = np.where(falling & (value >= level) & (next_v < level), cross, np.inf).min(1)
        found[f"up_{name}"], found[f"down_{name}"] = np.where(np.isneginf(up), np.nan, up), np.where(np.isposinf(down), np.nan, down)
        found[f"level_{name}"] = height
    return found


def _landmarks(value: np.ndarray, offset: np.ndarray, n: np.ndarray) -> dict:
    rows = np.arange(len(n))
    first_v, last_v, first_o, last_o = value[:, 0], value[rows, n - 1], offset[:, 0], offset[rows, n - 1]
    top, peak = np.nanmax(value, axis=1), _best(value, offset, np.ones_like(value, bool))
    rise, fall = (top - first_v) / (peak - first_o), (last_v - top) / (last_o - peak)
    before, behind = offset < peak[:, None], offset > peak[:, None]
    under = np.where(before, first_v[:, None] + rise[:, None] * (offset - first_o[:, None]) - value, np.where(behind, top[:, None] + fall[:, None] * (offset - peak[:, None]) - value, np.nan))
    under = np.round(under, 9)
    step = np.hstack([np.diff(value, axis=1), np.full((len(n), 1), np.nan)])
    notch = _best(under, offset, behind & (under > 0))
    second = _best(-step, offset, offset >= notch[:, None])
    bump = (offset >= notch[:, None]) & (offset <= second[:, None])
    diastolic = _best(value, offset, bump)
    return {
        "foot_offset": _best(under, offset, before),
        "notch_offset": notch,
        "fall_1_offset": _best(-step, offset, (offset >= peak[:, None]) & (offset < notch[:, None])),
        "fall_2_offset": second,
        "diastolic_offset": diastolic,
    }


def beat_measures(df: DataFrame, bounds: DataFrame, keys: list[str], samples: str, *, levels: tuple[int, ...] = (20, 50, 80), least: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a beat with its points, areas, slopes, level crossings and landmarks.

    Columns: n_samples, begin_value, end_value, peak_offset, peak_value, rise_offset (steepest), fall_offset, area (over
    the least value, unit spacing), area_over_line (distance from the line between both ends), peak_over_line, up_<p> and
    down_<p> (interpolated offsets at which p percent of the rise from the first value is passed last before the peak and
    first after it); foot_offset (the sample before the peak that lies furthest below the line from the begin to the
    peak), notch_offset (after the peak, furthest below the line from the peak to the end, only below it), fall_1_offset and
    fall_2_offset (steepest falls between peak and notch and after the notch), diastolic_offset and diastolic_value (the
    largest sample from the notch to fall_2). up_end_<p> and down_end_<p> are the same for levels from the last value, where p
    percent of the fall from the peak to it are done; level_<p> and level_end_<p> the levels themselves. <point>_value are the
    samples at the points, least_value the least one; low and high are the beat's bounds. Missing samples are skipped; equally good samples: the
    earliest; what isn't there is null. Beats of fewer than ``least`` samples are dropped.
    """
    offsets = [f"{p}_offset" for p in ("peak", "rise", "fall", "foot", "notch", "fall_1", "fall_2", "diastolic")]
    marks = ("rise", "foot", "fall_1", "fall_2", "notch", "diastolic")
    values = ["begin_value", "end_value", "peak_value", "least_value", "area", "area_over_line", "peak_over_line", *(f"{m}_value" for m in marks)]
    values += [f"{side}_{end}{p}" for p in levels for end in ("", "end_") for side in ("up", "down", "level")]
    fields = ", ".join(["n_samples long", *(f"{c} long" for c in offsets), *(f"{c} double" for c in values)])

    def measure(value: np.ndarray, offset: np.ndarray, n: np.ndarray, _: np.ndarray) -> dict:
        with np.errstate(invalid="ignore", divide="ignore"):
            found = _shape(value, offset, n, levels) | _landmarks(value, offset, n)
            found |= {f"{m}_value": _value_at(value, offset, found[f"{m}_offset"]) for m in marks}
        return found | {"keep": n >= least}

    return over_beats(df, bounds, keys, samples, measure, fields, carry=carry)


def beat_waves(df: DataFrame, bounds: DataFrame, keys: list[str], samples: str, rate: str, *, most_sec: float = 3.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """The known samples of each beat, of at most ``most_sec``, as an array ``wave``, and how much it moves.

    ``moving`` is the percentage of steps larger than half a unit; beats without two known samples have none.
    """

    def measure(value: np.ndarray, offset: np.ndarray, n: np.ndarray, _: np.ndarray) -> dict:
        steps = np.abs(np.diff(value, axis=1))
        with np.errstate(invalid="ignore", divide="ignore"):
            moving = np.where(n > 1, (steps > 0.5).sum(1) / (n - 1) * 100, np.nan)
        return {"wave": [v[:k] for v, k in zip(value, n, strict=True)], "moving": moving}

    rates = df.select(*(quoted(k).alias(f"__r{i}") for i, k in enumerate(keys)), quoted(rate).alias("__rate")).distinct()
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & quoted(k).eqNullSafe(F.col(f"__r{i}"))
    longest = F.coalesce(F.col("low") + F.floor(F.col("__rate") * most_sec), F.col("high"))
    short = bounds.join(broadcast_if_small(rates), same, "left").withColumn("high", F.least("high", longest)).select(*bounds.columns)
    return over_beats(df, short, keys, samples, measure, "wave array<double>, moving double", carry=carry)
