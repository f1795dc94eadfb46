"""Features of single beats and of beat sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions.common import join_summary, quoted
from pulseloom.operators.intervals import join_points
from pulseloom.operators.moving import _number


def samples_by_beat(signal: DataFrame, bounds: DataFrame, keys: list[str], position: str, bound: str) -> DataFrame:
    """Give each sample its beat: adds ``beat_no`` (from 0) and ``offset`` from the bound that begins the beat.

    A beat reaches from one bound to the next, both ends included, so a bound between two beats belongs to both.
    Samples before the first and after the last bound are dropped.
    """
    marks = bounds.select(*map(quoted, keys), quoted(bound).alias("__low")).where("__low is not null").distinct()
    w = Window.partitionBy(*map(quoted, keys)).orderBy("__low")
    marks = marks.withColumns({"beat_no": F.row_number().over(w) - 1, "__high": F.lead("__low").over(w)}).where("__high is not null")
    cell = 1024
    wide = marks.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__low") / cell), F.floor(F.col("__high") / cell))))
    rows = signal.withColumn("__cell", F.floor(quoted(position) / cell)).join(wide, [*keys, "__cell"])
    rows = rows.where(quoted(position).between(F.col("__low"), F.col("__high")))
    return rows.withColumn("offset", quoted(position) - F.col("__low")).drop("__cell", "__low", "__high")


def beat_shapes(beats: DataFrame, keys: list[str], value: str, *, levels: tuple[int, ...] = (20, 50, 80), least: int = 4) -> DataFrame:
    """One row per beat of long-form samples (keys, beat_no, offset, value): its points, areas, slopes and level crossings.

    Columns: n_samples, begin_value, end_value, peak_offset, peak_value, rise_offset (steepest), fall_offset, area (over
    the least value, unit spacing), area_over_line (distance from the line between both ends), peak_over_line,
    up_<p> and down_<p>: interpolated offsets at which p percent of the rise from the first value is passed last before
    the peak and first after it. Beats of fewer than ``least`` samples are dropped; equal extrema: the earliest.
    """
    by = [*map(quoted, keys), F.col("beat_no")]
    v, o = _number(value), F.col("offset")
    rows = beats.where(v.isNotNull())
    around = Window.partitionBy(*by).orderBy("offset")
    whole = Window.partitionBy(*by)
    top = F.max(F.struct(v.alias("v"), (-o).alias("p"))).over(whole)
    rows = rows.withColumns({
        "__v": v,
        "__next": F.lead(v).over(around),
        "__next_o": F.lead(o).over(around),
        "__first": F.min(F.struct(o.alias("o"), v.alias("v"))).over(whole),
        "__last": F.max(F.struct(o.alias("o"), v.alias("v"))).over(whole),
        "__top": top,
        "__min": F.min(v).over(whole),
    })
    rows = rows.withColumns({"__peak": -F.col("__top.p"), "__height": F.col("__top.v") - F.col("__first.v")})
    line = F.col("__first.v") + (F.col("__last.v") - F.col("__first.v")) * (o - F.col("__first.o")) / (F.col("__last.o") - F.col("__first.o"))
    rows = rows.withColumn("__off", F.col("__v") - line)
    rows = rows.withColumns({"__next_off": F.lead("__off").over(around), "__slope": (F.col("__next") - F.col("__v")) / (F.col("__next_o") - o)})
    trapezoid = lambda a, b: F.sum((a + b) / 2 * (F.col("__next_o") - o))
    before = F.col("__next_o") <= F.col("__peak")
    out = [
        F.count("*").alias("n_samples"),
        F.first("__first.v").alias("begin_value"),
        F.first("__last.v").alias("end_value"),
        F.first("__peak").alias("peak_offset"),
        F.first("__top.v").alias("peak_value"),
        F.max(F.when(before, F.struct(F.col("__slope").alias("s"), (-o).alias("p")))).alias("__rise"),
        F.max(F.when(o >= F.col("__peak"), F.struct((-F.col("__slope")).alias("s"), (-o).alias("p")))).alias("__fall"),
        trapezoid(F.col("__v") - F.col("__min"), F.col("__next") - F.col("__min")).alias("area"),
        trapezoid(F.abs("__off"), F.abs("__next_off")).alias("area_over_line"),
        F.max(F.when(o == F.col("__peak"), F.col("__off"))).alias("peak_over_line"),
    ]
    for p in levels:
        level = F.col("__first.v") + F.col("__height") * (p / 100)
        cross = o + (level - F.col("__v")) / F.col("__slope")
        out.append(F.max(F.when(before & (F.col("__v") < level) & (F.col("__next") >= level), cross)).alias(f"up_{p}"))
        out.append(F.min(F.when((o >= F.col("__peak")) & (F.col("__v") >= level) & (F.col("__next") < level), cross)).alias(f"down_{p}"))
    done = rows.groupBy(*by).agg(*out).where(F.col("n_samples") >= least)
    return done.withColumns({"rise_offset": -F.col("__rise.p"), "fall_offset": -F.col("__fall.p")}).drop("__rise", "__fall")


def beat_landmarks(beats: DataFrame, keys: list[str], value: str, *, least: int = 4) -> DataFrame:
    """Foot, notch and diastolic peak of each beat of long-form samples (keys, beat_no, offset, value).

    The foot is the sample before the peak that lies furthest below the line from the begin to the peak, the notch the
    one after the peak that lies furthest below the line from the peak to the end (null unless below it), ``fall_1`` and
    ``fall_2`` the steepest falls between peak and notch and after the notch, and the diastolic peak the largest sample
    from the notch to ``fall_2``. Equally good samples: the earliest. Beats of fewer than ``least`` samples are dropped.
    """
    by = [*map(quoted, keys), F.col("beat_no")]
    whole, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("offset")
    v, o = F.col("__v"), F.col("offset")
    rows = beats.withColumn("__v", _number(value)).where("__v is not null")
    point = lambda a: F.struct(a.alias("o"), v.alias("v"))
    top = F.max(F.struct(v.alias("v"), (-o).alias("p"))).over(whole)
    rows = rows.withColumns({"__first": F.min(point(o)).over(whole), "__last": F.max(point(o)).over(whole), "__top": top, "__n": F.count("*").over(whole), "__step": F.lead("__v").over(order) - v})
    rows = rows.withColumn("__peak", -F.col("__top.p")).where(F.col("__n") >= least)
    rise = F.try_divide(F.col("__top.v") - F.col("__first.v"), F.col("__peak") - F.col("__first.o"))
    fall = F.try_divide(F.col("__last.v") - F.col("__top.v"), F.col("__last.o") - F.col("__peak"))
    under = F.when(o < F.col("__peak"), F.col("__first.v") + rise * (o - F.col("__first.o")) - v).when(o > F.col("__peak"), F.col("__top.v") + fall * (o - F.col("__peak")) - v)
    rows = rows.withColumn("__under", F.round(under, 9))
    best = lambda keep: F.max(F.when(keep, F.struct(F.col("__under").alias("u"), (-o).alias("p"))))
    rows = rows.withColumns({"__foot": best(o < F.col("__peak")).over(whole), "__notch": best((o > F.col("__peak")) & (F.col("__under") > 0)).over(whole)})
    rows = rows.withColumn("__at", -F.col("__notch.p"))
    steep = lambda keep: F.max(F.when(keep & F.col("__step").isNotNull(), F.struct((-F.col("__step")).alias("s"), (-o).alias("p")))).over(whole)
    rows = rows.withColumns({"__f1": steep((o >= F.col("__peak")) & (o < F.col("__at"))), "__f2": steep(o >= F.col("__at"))})
    rows = rows.withColumn("__second", -F.col("__f2.p"))
    bump = F.max(F.when((o >= F.col("__at")) & (o <= F.col("__second")), F.struct(v.alias("v"), (-o).alias("p"))))
    return rows.groupBy(*by).agg(
        F.first("__peak").alias("peak_offset"),
        F.first(-F.col("__foot.p")).alias("foot_offset"),
        F.first("__at").alias("notch_offset"),
        F.first(-F.col("__f1.p")).alias("fall_1_offset"),
        F.first("__second").alias("fall_2_offset"),
        (-bump["p"]).alias("diastolic_offset"),
        bump["v"].alias("diastolic_value"),
        F.first("__top.v").alias("peak_value"),
        F.first("__first.v").alias("begin_value"),
        F.max(F.when(o == F.col("__at"), v)).alias("notch_value"),
    )


LEVELS = (20, 50, 80)
POINTS = ("rise", "foot", "peak", "fall_1", "notch", "diastolic", "fall_2")


def beat_timings(shapes: DataFrame, rate: str) -> DataFrame:
    """Add times in ms to a table of beat measures: from half rise to each point and crossing, widths at each level, and relative amplitudes.

    ``ms_half_to_<point>`` for all points and for the begin, ``ms_half_to_<side>_<level>`` for the crossings of levels from the
    first and the last value, ``ms_width_<level>`` between the crossings of a level, ``ms_length``, ``pulse_ratio`` (peak -
    diastolic over peak), ``foot_ratio`` and ``peak_ratio`` (over the least value), and ``<point>_over_begin`` and
    ``level_<level>_over_begin``. Unknown points give null.
    """
    ms = lambda x: x / quoted(rate) * 1000
    levels = [f"{end}{p}" for end in ("", "end_") for p in LEVELS]
    out = {f"ms_half_to_{p}": ms(F.col(f"{p}_offset") - F.col("up_50")) for p in POINTS} | {"ms_half_to_begin": ms(-F.col("up_50"))}
    out |= {f"ms_half_to_{side}_{p}": ms(F.col(f"{side}_{p}") - F.col("up_50")) for p in levels for side in ("up", "down") if (side, p) != ("up", "50")}
    out |= {f"ms_width_{p}": ms(F.abs(F.col(f"down_{p}") - F.col(f"up_{p}"))) for p in levels} | {"ms_length": ms(F.col("high") - F.col("low"))}
    out["pulse_ratio"] = F.try_divide(F.col("peak_value") - F.col("diastolic_value"), F.col("peak_value"))
    out |= {f"{p}_ratio": F.try_divide(F.col(f"{p}_value"), F.col("least_value")) for p in ("foot", "peak")}
    out |= {f"{p}_over_begin": F.col(f"{p}_value") - F.col("begin_value") for p in (*POINTS, "end")}
    out |= {f"level_{p}_over_begin": F.col(f"level_{p}") - F.col("begin_value") for p in levels}
    return shapes.withColumns(out)


def beat_positions(shapes: DataFrame, begin: str) -> DataFrame:
    """Add ``idx_<point>``, ``idx_begin`` and ``idx_end``: positions in the recording of the points of beats whose channel begins at ``begin``."""
    at = quoted(begin) + F.col("low")
    out = {f"idx_{p}": at + F.col(f"{p}_offset") for p in POINTS} | {"idx_begin": at, "idx_end": quoted(begin) + F.col("high")}
    return shapes.withColumns(out)


def delays_from_peak(timings: DataFrame, r_sec: str, begin_sec: str) -> DataFrame:
    """Add ``ms_r_to_<point>``: ms from the R peak at ``r_sec`` to each point of a beat that begins at ``begin_sec``; null without an R peak."""
    begin = (quoted(begin_sec) - quoted(r_sec)) * 1000
    half = begin - F.col("ms_half_to_begin")
    return timings.withColumns({"ms_r_to_begin": begin} | {f"ms_r_to_{p}": half + F.col(f"ms_half_to_{p}") for p in POINTS})


def level_crossings(df: DataFrame, keys: list[str], position: str, value: str, level: float) -> DataFrame:
    """Interpolated positions at which a channel passes ``level``: keys, position, direction ("up", "down"); touching isn't passing."""
    w = Window.partitionBy(*map(quoted, keys)).orderBy(quoted(position))
    v = _number(value) - level
    rows = df.where(v.isNotNull()).withColumns({"__v": v}).withColumns({"__n": F.lead("__v").over(w), "__p": F.lead(quoted(position)).over(w)})
    crossing = rows.where(((F.col("__v") <= 0) & (F.col("__n") > 0)) | ((F.col("__v") > 0) & (F.col("__n") <= 0)))
    at = quoted(position) + (F.col("__p") - quoted(position)) * F.col("__v") / (F.col("__v") - F.col("__n"))
    return crossing.select(*map(quoted, keys), at.alias("crossing"), F.when(F.col("__n") > 0, "up").otherwise("down").alias("direction"))


def point_intervals(df: DataFrame, keys: list[str], order: str, points: list[str], rate: str) -> DataFrame:
    """Add ``sec_<p>_2_<p>`` for sample-index columns: seconds since the same point of the previous beat, 0 for the first or an unknown one."""
    w = Window.partitionBy(*map(quoted, keys)).orderBy(quoted(order))
    return df.withColumns({f"sec_{p}_2_{p}": F.coalesce((quoted(p) - F.lag(quoted(p)).over(w)) / quoted(rate), F.lit(0.0)) for p in points})


def segment_offsets(segments: DataFrame, keys: list[str], order: str, length: str, out: str = "offset") -> DataFrame:
    """Total length of an entity's earlier segments, to lay their indices one behind the other."""
    w = Window.partitionBy(*map(quoted, keys)).orderBy(quoted(order)).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn(out, F.coalesce(F.sum(quoted(length)).over(w), F.lit(0)))


def original_positions(points: DataFrame, pieces: DataFrame, keys: list[str], at: str, offset: str, length: str, begin: str, *, cell: int = 1 << 20, out: str = "position") -> DataFrame:
    """Map positions in an entity's pieces laid one behind the other back to the recording: adds ``out``, and the columns of ``pieces``.

    ``pieces`` has each piece's ``offset`` among the others, its ``length`` and its ``begin`` in the recording. Positions in
    no piece are dropped.
    """
    ends = pieces.withColumns({"__low": quoted(offset), "__high": quoted(offset) + quoted(length) - 1})
    joined = join_points(ends, points, keys, at, "__low", "__high", cell=cell)
    return joined.withColumn(out, quoted(begin) + quoted(at) - quoted(offset)).drop("__low", "__high")


def concatenated(rows: DataFrame, keys: list[str], order: list[str], *, cell: float, out: str = "position") -> DataFrame:
    """Number an entity's rows from 0 in ``order``, as in the series that is left when others were taken out.

    ``order[0]`` is a number; rows are numbered inside cells of ``cell`` units of it, and the cells' sizes are summed up,
    so no entity is one window. Rows without that number are dropped.
    """
    own = rows.where(quoted(order[0]).isNotNull()).withColumn("__cell", F.floor(quoted(order[0]) / cell))
    sizes = own.groupBy(*map(quoted, keys), "__cell").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*map(quoted, keys)).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*map(quoted, keys), "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy(*map(quoted, keys), "__cell").orderBy(*map(quoted, order))) - 1
    return join_summary(own.withColumn("__place", place), starts, [*keys, "__cell"]).withColumn(out, F.col("__start") + F.col("__place")).drop("__cell", "__start", "__place")


def edge_flags(df: DataFrame, keys: list[str], part: str, order: str, out: str = "is_edge") -> DataFrame:
    """Mark the first and last row of each part of an entity, but not the entity's very first and last row.

    Bounds are aggregated, by part and then by entity, and joined to the rows; a row without an order has a null mark.
    """
    bounds = df.groupBy(*map(quoted, keys), quoted(part)).agg(F.min(quoted(order)).alias("__low"), F.max(quoted(order)).alias("__high"))
    ends = bounds.groupBy(*map(quoted, keys)).agg(F.min("__low").alias("__first"), F.max("__high").alias("__last"))
    rows = join_summary(df, join_summary(bounds, ends, keys), list(dict.fromkeys([*keys, part])))
    place = quoted(order)
    edge = ((place == F.col("__low")) | (place == F.col("__high"))) & ~((place == F.col("__first")) | (place == F.col("__last")))
    return rows.withColumn(out, edge).drop("__low", "__high", "__first", "__last")


def _with_sleep(df: DataFrame, keys: list[str], at: str, stage: str, wake: float) -> DataFrame:
    """Add the first and last sleeping row's place of each entity, ``__onset`` and ``__offset``; null without sleep."""
    asleep = F.when(quoted(stage) != wake, quoted(at))
    return join_summary(df, df.groupBy(*map(quoted, keys)).agg(F.min(asleep).alias("__onset"), F.max(asleep).alias("__offset")), keys)


def sleep_phases(df: DataFrame, keys: list[str], order: str, stage: str, out: str = "phase", *, wake: float = 0, rem: float = -1) -> DataFrame:
    """0 wake before sleep, 1 non-REM, 2 REM, 3 wake during sleep, 4 wake after sleep; entities without sleep are 0."""
    onset, offset = F.col("__onset"), F.col("__offset")
    phase = (
        F.when(quoted(stage).isNull(), None)
        .when((quoted(stage) == wake) & (onset.isNull() | (quoted(order) < onset)), 0)
        .when((quoted(stage) == wake) & (quoted(order) > offset), 4)
        .when(quoted(stage) == wake, 3)
        .when(quoted(stage) == rem, 2)
        .otherwise(1)
    )
    return _with_sleep(df, keys, order, stage, wake).withColumn(out, phase).drop("__onset", "__offset")


def sleep_onsets(df: DataFrame, keys: list[str], at: str, stage: str, *, wake: float = 0) -> DataFrame:
    """Add ``since_onset`` and ``to_last_sleep``: time from the entity's first sleeping row, and to its last one."""
    rows = _with_sleep(df, keys, at, stage, wake)
    return rows.withColumns({"since_onset": quoted(at) - F.col("__onset"), "to_last_sleep": F.col("__offset") - quoted(at)}).drop("__onset", "__offset")


def recode_stages(stage: str):
    """Raw stage codes to internal ones: 0 wake, -1 REM (5), -2..-5 the others (1..4), -6 unknown (below 0, above 5, null)."""
    s = quoted(stage)
    return F.when(s.isNull() | (s < 0) | (s > 5), -6).when(s == 5, -1).when(s == 0, 0).otherwise(-(s + 1)).cast("int")


def beat_delays(df: DataFrame, keys: list[str], order: str, begin: str, delay: str, rate: str) -> DataFrame:
    """Per beat: ``d`` (ms to the next beat's point, the last beat repeats the one before), ``a`` (delay) and ``b`` = a + d."""
    w = Window.partitionBy(*map(quoted, keys)).orderBy(quoted(order))
    step = (F.lead(quoted(begin)).over(w) - quoted(begin)) / quoted(rate) * 1000
    rows = df.withColumn("__step", step)
    rows = rows.withColumn("d", F.coalesce("__step", F.lag("__step").over(w))).drop("__step")
    return rows.withColumns({"a": quoted(delay), "b": quoted(delay) + F.col("d")})
