"""Registered queries of the beat feature, window statistics, set and scalar operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.functions.common import cut, load
from pulseloom.operators import channels as C
from pulseloom.operators import features as B
from pulseloom.operators import intervals as I
from pulseloom.operators import templates as T
from pulseloom.operators import windows as S
from pulseloom.operators.moving import exact_median
from pulseloom.plans.signal_queries import EXTREMA, extrema
from pulseloom.plans.views import BEATS_SQL, EPOCHS_SQL, MERGED_SQL, SEG, WAVES_SQL, beats, channel_arrays, epochs, events_of, events_sql, markings, rounded, signal, signal_sql, waves

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FEATURES = ["sec_valley_2_valley", "area"]
WIDTH = 300.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SHAPES = EXTREMA + """, vl AS (SELECT rec_id, seg_id, idx AS low, row_number() OVER (PARTITION BY rec_id, seg_id ORDER BY idx) - 1 AS beat_no, lead(idx) OVER (PARTITION BY rec_id, seg_id ORDER BY idx) AS high
  FROM tp WHERE place = 1 AND NOT up),
bs AS (SELECT s.rec_id, s.seg_id, beat_no, idx - low AS o, value AS v FROM sig s JOIN vl ON s.rec_id = vl.rec_id AND s.seg_id = vl.seg_id AND high IS NOT NULL AND idx BETWEEN low AND high WHERE value IS NOT NULL),
b1 AS (SELECT *, lead(v) OVER w AS nv, lead(o) OVER w AS no, first_value(v) OVER w AS fv, first_value(o) OVER w AS fo, last_value(v) OVER x AS lv, last_value(o) OVER x AS lo, min(v) OVER x AS mn,
  max(v) OVER x AS top, count(*) OVER x AS n FROM bs WINDOW w AS (PARTITION BY rec_id, seg_id, beat_no ORDER BY o), x AS (PARTITION BY rec_id, seg_id, beat_no ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
b2 AS (SELECT *, min(CASE WHEN v = top THEN o END) OVER (PARTITION BY rec_id, seg_id, beat_no) AS pk, v - (fv + (lv - fv) * (o - fo) / nullif(lo - fo, 0)) AS off, (nv - v) / (no - o) AS slope FROM b1),
b3 AS (SELECT *, lead(off) OVER (PARTITION BY rec_id, seg_id, beat_no ORDER BY o) AS noff FROM b2)
"""


def beat_measures(spark: SparkSession, d: str) -> DataFrame:
    """All measures of the beats between the valleys of the pulse wave excerpts."""
    own = channel_arrays(spark, d)
    bounds = cut(C.beat_bounds(extrema(own).where("kind = 'valley'"), SEG))
    return C.beat_measures(own, bounds, SEG, "x", carry=("fs",))


LEVELS = ", ".join(
    f"round(max(CASE WHEN no <= pk AND v < fv + (top - fv) * {p / 100} AND nv >= fv + (top - fv) * {p / 100} THEN o + (fv + (top - fv) * {p / 100} - v) / slope END) + 3e-7, 4) AS up_{p}, "
    f"round(min(CASE WHEN o >= pk AND v >= fv + (top - fv) * {p / 100} AND nv < fv + (top - fv) * {p / 100} THEN o + (fv + (top - fv) * {p / 100} - v) / slope END) + 3e-7, 4) AS down_{p}"
    for p in (20, 50, 80)
)


@query(SHAPES + f"""SELECT rec_id, seg_id, beat_no::INT AS beat_no, n AS n_samples, round(any_value(fv), 6) AS begin_value, round(any_value(lv), 6) AS end_value, any_value(pk) AS peak_offset, round(any_value(top), 6) AS peak_value,
  round(sum((v - mn + nv - mn) / 2 * (no - o)), 4) AS area, round(sum((abs(off) + abs(noff)) / 2 * (no - o)), 4) AS area_over_line, round(max(CASE WHEN o = pk THEN off END), 4) AS peak_over_line, {LEVELS}
FROM b3 WHERE n >= 4 GROUP BY rec_id, seg_id, beat_no, n""")
def beat_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Points, areas and level crossings of each beat of the pulse wave excerpts."""
    rows = beat_measures(spark, d)
    near = {c: 6 for c in ("begin_value", "end_value", "peak_value")} | {c: 4 for c in ("area", "area_over_line", "peak_over_line")}
    crossings = [f"{side}_{p}" for side in ("up", "down") for p in (20, 50, 80)]
    return rows.select(
        *SEG, "beat_no", "n_samples", "peak_offset", *(rounded(c, n).alias(c) for c, n in near.items()), *(rounded(F.col(c) + 3e-7, 4).alias(c) for c in crossings)
    )


@query()
def beat_slopes(spark: SparkSession, d: str) -> DataFrame:
    """Where each beat rises and falls most steeply, and its relative height."""
    rows = beat_measures(spark, d)
    height = F.try_divide(F.col("peak_value") - F.col("end_value"), F.col("peak_value"))
    return rows.select(*SEG, "beat_no", "rise_offset", "fall_offset", rounded(height).alias("relative_height"))


LANDMARKS = """, m1 AS (SELECT *, CASE WHEN o < pk THEN round(fv + (top - fv) / nullif(pk - fo, 0) * (o - fo) - v, 9) WHEN o > pk THEN round(top + (lv - top) / nullif(lo - pk, 0) * (o - pk) - v, 9) END AS under, nv - v AS step FROM b2 WHERE n >= 4),
m2 AS (SELECT *, max(CASE WHEN o < pk AND under IS NOT NULL THEN row(under, -o) END) OVER x AS ft, max(CASE WHEN o > pk AND under > 0 THEN row(under, -o) END) OVER x AS nt FROM m1 WINDOW x AS (PARTITION BY rec_id, seg_id, beat_no)),
m3 AS (SELECT *, max(CASE WHEN step IS NOT NULL AND o >= pk AND o < -nt[2] THEN row(-step, -o) END) OVER x AS f1, max(CASE WHEN step IS NOT NULL AND o >= -nt[2] THEN row(-step, -o) END) OVER x AS f2 FROM m2 WINDOW x AS (PARTITION BY rec_id, seg_id, beat_no)), d AS (SELECT rec_id, seg_id, beat_no::INT AS beat_no, any_value(pk) AS peak_offset, any_value(-ft[2]) AS foot_offset, any_value(-nt[2]) AS notch_offset, any_value(-f1[2]) AS fall_1_offset, any_value(-f2[2]) AS fall_2_offset,
  -(max(CASE WHEN o >= -nt[2] AND o <= -f2[2] THEN row(v, -o) END))[2] AS diastolic_offset FROM m3 GROUP BY ALL)"""


@query(SHAPES + LANDMARKS + " SELECT * FROM d")
def beat_landmarks(spark: SparkSession, d: str) -> DataFrame:
    """Foot, notch, steepest falls and diastolic peak of each beat."""
    rows = beat_measures(spark, d)
    return rows.select(*SEG, "beat_no", *(f"{p}_offset" for p in ("peak", "foot", "notch", "fall_1", "fall_2", "diastolic")))


MARKS = SHAPES + LANDMARKS
CROSSINGS = ", ".join(
    f"max(CASE WHEN no <= pk AND v < fv + (top - fv) * {p / 100} AND nv >= fv + (top - fv) * {p / 100} THEN o + (fv + (top - fv) * {p / 100} - v) / slope END) AS u{p}, "
    f"min(CASE WHEN o >= pk AND v >= fv + (top - fv) * {p / 100} AND nv < fv + (top - fv) * {p / 100} THEN o + (fv + (top - fv) * {p / 100} - v) / slope END) AS w{p}"
    for p in (20, 50, 80)
)
AT = {p: f"max(CASE WHEN o = {p}_offset THEN v END)" for p in ("foot", "notch", "fall_1", "fall_2", "diastolic")}


@query(MARKS + f""", pt AS (SELECT d.rec_id, d.seg_id, d.beat_no, any_value(fv) AS fv, any_value(lv) AS lv, any_value(mn) AS mn, any_value(top) AS top, any_value(pk) AS pk, any_value(foot_offset) AS foot, any_value(notch_offset) AS notch,
  any_value(diastolic_offset) AS dia, {', '.join(f'{sql} AS v_{p}' for p, sql in AT.items())}, {CROSSINGS}
  FROM d JOIN b3 USING (rec_id, seg_id, beat_no) GROUP BY d.rec_id, d.seg_id, d.beat_no), fr AS (SELECT DISTINCT rec_id, seg_id, fs FROM sig)
SELECT rec_id, seg_id, beat_no, {', '.join(f'round(({c} - u50) / fs * 1000 + 3e-7, 4) AS ms_half_to_{p}' for p, c in (('peak', 'pk'), ('foot', 'foot'), ('notch', 'notch'), ('diastolic', 'dia')))},
  {', '.join(f'round(abs(w{p} - u{p}) / fs * 1000 + 3e-7, 4) AS ms_width_{p}' for p in (20, 50, 80))},
  round((top - v_diastolic) / nullif(top, 0), 4) AS pulse_ratio, {', '.join(f'round(v_{p} - fv, 6) AS {p}_over_begin' for p in AT)}, round(top / nullif(mn, 0), 4) AS peak_ratio FROM pt JOIN fr USING (rec_id, seg_id)""")
def beat_timings(spark: SparkSession, d: str) -> DataFrame:
    """Times between the points of each beat, widths and relative amplitudes."""
    rows = B.beat_timings(beat_measures(spark, d), "fs")
    names = [*(f"ms_half_to_{p}" for p in ("peak", "foot", "notch", "diastolic")), *(f"ms_width_{p}" for p in (20, 50, 80))]
    times = (rounded(F.col(c) + 3e-7, 4).alias(c) for c in names)
    return rows.select(*SEG, "beat_no", *times, *(rounded(c, 4).alias(c) for c in ("pulse_ratio", "peak_ratio")), *(rounded(f"{p}_over_begin").alias(f"{p}_over_begin") for p in AT))


END_LEVELS = ", ".join(
    f"round(max(CASE WHEN no <= pk AND v < lv + (top - lv) * {(100 - p) / 100} AND nv >= lv + (top - lv) * {(100 - p) / 100} THEN o + (lv + (top - lv) * {(100 - p) / 100} - v) / slope END) + 3e-7, 4) AS up_end_{p}, "
    f"round(min(CASE WHEN o >= pk AND v >= lv + (top - lv) * {(100 - p) / 100} AND nv < lv + (top - lv) * {(100 - p) / 100} THEN o + (lv + (top - lv) * {(100 - p) / 100} - v) / slope END) + 3e-7, 4) AS down_end_{p}"
    for p in (20, 50, 80)
)


@query(SHAPES + f"SELECT rec_id, seg_id, beat_no::INT AS beat_no, {END_LEVELS} FROM b3 WHERE n >= 4 GROUP BY rec_id, seg_id, beat_no")
def beat_end_levels(spark: SparkSession, d: str) -> DataFrame:
    """Where each beat passes the levels of its fall, counted from its last value."""
    names = [f"{side}_end_{p}" for p in (20, 50, 80) for side in ("up", "down")]
    return beat_measures(spark, d).select(*SEG, "beat_no", *(rounded(F.col(c) + 3e-7, 4).alias(c) for c in names))


@query(MARKS + """, sb AS (SELECT rec_id, seg_id, max(ppg_begin) AS ppg_begin FROM segment WHERE ppg_begin IS NOT NULL GROUP BY ALL)
SELECT d.rec_id, d.seg_id, d.beat_no, ppg_begin + low AS idx_begin, ppg_begin + high AS idx_end, (ppg_begin + low + foot_offset)::BIGINT AS idx_foot, (ppg_begin + low + peak_offset)::BIGINT AS idx_peak,
  (ppg_begin + low + notch_offset)::BIGINT AS idx_notch, (ppg_begin + low + diastolic_offset)::BIGINT AS idx_diastolic FROM d JOIN vl USING (rec_id, seg_id, beat_no) JOIN sb USING (rec_id, seg_id)""")
def beat_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions of each beat's points in the recording."""
    begins = load(spark, d, "segment").where("ppg_begin is not null").groupBy(*SEG).agg(F.max("ppg_begin").alias("ppg_begin"))
    rows = B.beat_positions(beat_measures(spark, d).join(begins, SEG), "ppg_begin")
    return rows.select(*SEG, "beat_no", *(f"idx_{p}" for p in ("begin", "end", "foot", "peak", "notch", "diastolic")))


def beat_scores(spark: SparkSession, d: str) -> DataFrame:
    own = channel_arrays(spark, d)
    bounds = cut(C.beat_bounds(extrema(own).where("kind = 'valley'"), SEG))
    waves = C.beat_waves(own, bounds, SEG, "x", "fs", carry=("fs",)).withColumn("sec", F.col("low") / F.col("fs"))
    return T.beat_quality(cut(waves), SEG, carry=("sec",))


@query()
def beat_quality(spark: SparkSession, d: str) -> DataFrame:
    """Four scores and the quality class of each beat against its segment's median beat."""
    return beat_scores(spark, d).select(*SEG, "beat_no", *(rounded(c, 4).alias(c) for c in ("direct", "resampled", "warped", "moving", "frechet")), "quality_class")


@query()
def block_quality(spark: SparkSession, d: str) -> DataFrame:
    """Mean scores of the beats in blocks of 30 s, and the class of the block."""
    names = ("direct", "resampled", "warped", "moving")
    blocks = beat_scores(spark, d).groupBy(*SEG, F.floor(F.col("sec") / 30).alias("block")).agg(F.count("*").alias("n_beats"), *(F.avg(c).alias(c) for c in names))
    return blocks.select(*SEG, "block", "n_beats", *(rounded(c, 4).alias(c) for c in names), T.quality_class(*map(F.col, names)).alias("quality_class"))


@query(f"""WITH {WAVES_SQL}, c AS (SELECT label, vec_id, pos, value AS v, lead(value) OVER w AS n, lead(pos) OVER w AS p FROM wv WINDOW w AS (PARTITION BY vec_id ORDER BY pos))
SELECT label, vec_id, round(pos + (p - pos) * v / (v - n), 5) AS crossing, CASE WHEN n > 0 THEN 'up' ELSE 'down' END AS direction FROM c WHERE v <= 0 AND n > 0 OR v > 0 AND n <= 0""")
def level_crossing(spark: SparkSession, d: str) -> DataFrame:
    """Where the embedding waves pass zero."""
    rows = B.level_crossings(waves(spark, d), ["label", "vec_id"], "pos", "value", 0.0)
    return rows.select("label", "vec_id", rounded("crossing", 5).alias("crossing"), "direction")


@query(f"""WITH {BEATS_SQL} SELECT rec_id, seg_id, beat_no, round(coalesce((idx_begin - lag(idx_begin) OVER w) / ppg_rate, 0), 6) AS sec_begin, round(coalesce((idx_systolic - lag(idx_systolic) OVER w) / ppg_rate, 0), 6) AS sec_systolic
FROM beats WINDOW w AS (PARTITION BY rec_id, seg_id ORDER BY beat_no)""")
def interval_series(spark: SparkSession, d: str) -> DataFrame:
    """Seconds from each beat's begin and systolic peak to those of the beat before."""
    rows = B.point_intervals(beats(spark, d), SEG, "beat_no", ["idx_begin", "idx_systolic"], "ppg_rate")
    return rows.select(*SEG, "beat_no", rounded("sec_idx_begin_2_idx_begin").alias("sec_begin"), rounded("sec_idx_systolic_2_idx_systolic").alias("sec_systolic"))


@query("""WITH s AS (SELECT DISTINCT rec_id, seg_id, ecg_end - ecg_begin AS length FROM segment)
SELECT rec_id, seg_id, coalesce(sum(length) OVER (PARTITION BY rec_id ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_samples FROM s""")
def offset_concat(spark: SparkSession, d: str) -> DataFrame:
    """Where each segment begins when a recording's segments are laid one behind the other."""
    own = load(spark, d, "segment").select(*SEG, (F.col("ecg_end") - F.col("ecg_begin")).alias("length")).distinct()
    return B.segment_offsets(own, ["rec_id"], "seg_id", "length", "offset_samples").select(*SEG, "offset_samples")


@query(f"""WITH sg AS (SELECT rec_id, seg_id, max(ecg_begin) AS first, max(ecg_end - ecg_begin) AS length, max(ecg_rate) AS fs FROM segment GROUP BY ALL),
o AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY rec_id ORDER BY seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM sg), {events_sql('r_peak', 'p')}
SELECT p.rec_id, p.seg_id, (off + idx)::BIGINT AS at, (first + idx)::BIGINT AS position, round((first + idx) / fs, 6) AS sec FROM p JOIN o ON p.rec_id = o.rec_id AND p.seg_id = o.seg_id WHERE idx < length""")
def original_positions(spark: SparkSession, d: str) -> DataFrame:
    """R peaks of the segments laid one behind the other, and where they are in the recording."""
    segments = load(spark, d, "segment").groupBy(*SEG).agg(F.max("ecg_begin").alias("first"), F.max(F.col("ecg_end") - F.col("ecg_begin")).alias("length"), F.max("ecg_rate").alias("fs"))
    pieces = B.segment_offsets(segments, ["rec_id"], "seg_id", "length", "off")
    peaks = events_of(spark, d, "r_peak").join(pieces.select(*SEG, "off", "length"), SEG).where("idx < length").select("rec_id", (F.col("off") + F.col("idx")).alias("at"))
    rows = B.original_positions(peaks, pieces, ["rec_id"], "at", "off", "length", "first")
    return rows.select(*SEG, "at", "position", rounded(F.col("position") / F.col("fs")).alias("sec"))


@query(f"""WITH {BEATS_SQL}, t AS (SELECT * FROM beats WHERE sec IS NOT NULL), e AS (SELECT *, (sec = min(sec) OVER p OR sec = max(sec) OVER p) AND NOT (sec = min(sec) OVER q OR sec = max(sec) OVER q) AS is_edge
  FROM t WINDOW p AS (PARTITION BY rec_id, seg_id), q AS (PARTITION BY rec_id)) SELECT rec_id, seg_id, beat_no, is_edge FROM e""")
def first_last_flags(spark: SparkSession, d: str) -> DataFrame:
    """First and last beats of segments, but not of the recording."""
    return B.edge_flags(beats(spark, d).where("sec is not null"), ["rec_id"], "seg_id", "sec").select(*SEG, "beat_no", "is_edge")


RECODE = "CASE WHEN stage IS NULL OR stage < 0 OR stage > 5 THEN -6 WHEN stage = 5 THEN -1 WHEN stage = 0 THEN 0 ELSE -(stage + 1) END"


@query(f"WITH {EPOCHS_SQL} SELECT rec_id, epoch_no, ({RECODE})::INT AS code FROM ep")
def state_recode(spark: SparkSession, d: str) -> DataFrame:
    """Internal codes of the raw stages."""
    return epochs(spark, d).select("rec_id", "epoch_no", B.recode_stages("stage").alias("code"))


PHASES = f"WITH {EPOCHS_SQL}, c AS (SELECT rec_id, epoch_no, {RECODE} AS code FROM ep), o AS (SELECT *, min(CASE WHEN code <> 0 THEN epoch_no END) OVER (PARTITION BY rec_id) AS a, max(CASE WHEN code <> 0 THEN epoch_no END) OVER (PARTITION BY rec_id) AS z FROM c)"


@query(PHASES + """ SELECT rec_id, epoch_no, CASE WHEN code = 0 AND (a IS NULL OR epoch_no < a) THEN 0 WHEN code = 0 AND epoch_no > z THEN 4 WHEN code = 0 THEN 3 WHEN code = -1 THEN 2 ELSE 1 END AS phase FROM o""")
def sleep_phases(spark: SparkSession, d: str) -> DataFrame:
    """Wake before, during and after sleep, REM and other sleep."""
    rows = epochs(spark, d).withColumn("code", B.recode_stages("stage"))
    return B.sleep_phases(rows, ["rec_id"], "epoch_no", "code").select("rec_id", "epoch_no", "phase")


@query(PHASES + " SELECT rec_id, epoch_no, epoch_no - a AS since_onset, z - epoch_no AS to_last_sleep FROM o")
def sleep_onset_offset(spark: SparkSession, d: str) -> DataFrame:
    """Epochs since the first and to the last sleeping epoch."""
    rows = epochs(spark, d).withColumn("code", B.recode_stages("stage"))
    return B.sleep_onsets(rows, ["rec_id"], "epoch_no", "code").select("rec_id", "epoch_no", "since_onset", "to_last_sleep")


@query(PHASES + """, b AS (SELECT DISTINCT rec_id, epoch_no // 10 AS block, a, z FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY abs(block * 10 - a), block) AS p, row_number() OVER (PARTITION BY rec_id ORDER BY abs(block * 10 - z), block) AS q FROM b)
SELECT rec_id, block::BIGINT AS block, a IS NOT NULL AND p = 1 AS nears_onset, z IS NOT NULL AND q = 1 AS nears_end FROM r""")
def onset_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of ten epochs, with the ones that begin nearest to the onset and the end of sleep marked."""
    rows = epochs(spark, d).withColumn("code", B.recode_stages("stage"))
    ends = rows.groupBy("rec_id").agg(F.min(F.when(F.col("code") != 0, F.col("epoch_no"))).alias("a"), F.max(F.when(F.col("code") != 0, F.col("epoch_no"))).alias("z"))
    blocks = rows.select("rec_id", F.floor(F.col("epoch_no") / 10).alias("block")).distinct().join(ends, "rec_id")
    place = lambda c: F.row_number().over(Window.partitionBy("rec_id").orderBy(F.abs(F.col("block") * 10 - F.col(c)), "block"))
    marked = blocks.withColumns({"p": place("a"), "q": place("z")})
    return marked.select("rec_id", "block", (F.col("a").isNotNull() & (F.col("p") == 1)).alias("nears_onset"), (F.col("z").isNotNull() & (F.col("q") == 1)).alias("nears_end"))


@query(f"""WITH {BEATS_SQL}, t AS (SELECT *, (lead(idx_begin) OVER w - idx_begin) / ppg_rate * 1000 AS step, (idx_systolic - idx_begin) / ppg_rate * 1000 AS delay FROM beats WINDOW w AS (PARTITION BY rec_id, seg_id ORDER BY beat_no)),
u AS (SELECT *, coalesce(step, lag(step) OVER (PARTITION BY rec_id, seg_id ORDER BY beat_no)) AS d FROM t)
SELECT rec_id, seg_id, beat_no, round(d, 4) AS d, round(delay, 4) AS a, round(delay + d, 4) AS b FROM u""")
def beat_delays(spark: SparkSession, d: str) -> DataFrame:
    """Beat length, rise time and their sum for each beat, in ms."""
    rows = beats(spark, d).withColumn("delay", (F.col("idx_systolic") - F.col("idx_begin")) / F.col("ppg_rate") * 1000)
    rows = B.beat_delays(rows, SEG, "beat_no", "idx_begin", "delay", "ppg_rate")
    return rows.select(*SEG, "beat_no", *(rounded(c, 4).alias(c) for c in ("d", "a", "b")))


LONG = f"WITH {BEATS_SQL}, lg AS (SELECT rec_id, floor(sec / 300)::BIGINT AS window_no, sec, 'sec_valley_2_valley' AS feature, sec_valley_2_valley AS value FROM beats WHERE sec IS NOT NULL UNION ALL SELECT rec_id, floor(sec / 300)::BIGINT, sec, 'area', area FROM beats WHERE sec IS NOT NULL)"
STATS_SQL = LONG + """, ws AS (SELECT rec_id, window_no, feature, count(*) AS n, count(*) - count(value) AS n_null, round(avg(value), 6) AS avg, round(median(value), 6) AS med, round(max(value), 6) AS max, round(min(value), 6) AS min,
  CASE WHEN count(value) = 1 THEN 0 ELSE round(regr_slope(value, sec), 6) END AS slope FROM lg GROUP BY ALL)"""


@query(STATS_SQL + " SELECT * FROM ws")
def window_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts, means, medians, extremes and slopes of two features in windows of 300 s."""
    rows = S.window_statistics(beats(spark, d), ["rec_id"], "sec", FEATURES, WIDTH)
    return rows.select("rec_id", "window_no", "feature", "n", "n_null", *(rounded(c).alias(c) for c in ("avg", "med", "max", "min", "slope")))


@query(LONG + """, rk AS (SELECT *, row_number() OVER (PARTITION BY rec_id, window_no, feature ORDER BY value) AS i, count(*) OVER (PARTITION BY rec_id, window_no, feature) AS n FROM lg WHERE value IS NOT NULL),
pl AS (SELECT *, least(greatest(n * 0.25 + 0.5, 1), n) AS p1, least(greatest(n * 0.75 + 0.5, 1), n) AS p3 FROM rk),
ab AS (SELECT rec_id, window_no, feature, max(p1) AS p1, max(p3) AS p3, max(CASE WHEN i = floor(p1) THEN value END) AS a1, max(CASE WHEN i = least(floor(p1) + 1, n) THEN value END) AS b1,
  max(CASE WHEN i = floor(p3) THEN value END) AS a3, max(CASE WHEN i = least(floor(p3) + 1, n) THEN value END) AS b3 FROM pl GROUP BY ALL)
SELECT rec_id, window_no, feature, round(a1 + (b1 - a1) * (p1 - floor(p1)), 6) AS q1, round(a3 + (b3 - a3) * (p3 - floor(p3)), 6) AS q3 FROM ab""")
def window_quartiles_exact(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles at n p + 1/2 in windows of 300 s."""
    rows = S.window_quantiles(beats(spark, d), ["rec_id"], "sec", FEATURES, WIDTH, {"q1": 0.25, "q3": 0.75})
    return rows.select("rec_id", "window_no", "feature", rounded("q1").alias("q1"), rounded("q3").alias("q3"))


@query(STATS_SQL + """, lt AS (SELECT rec_id, max(window_no) AS z FROM ws GROUP BY rec_id), gr AS (SELECT rec_id, unnest(range(0, z + 1)) AS window_no FROM lt), gf AS (SELECT * FROM gr, (VALUES ('area'), ('sec_valley_2_valley')) f(feature))
SELECT rec_id, window_no, feature, coalesce(n, 0) AS n, coalesce(n_null, 0) AS n_null, avg FROM gf LEFT JOIN ws USING (rec_id, window_no, feature)""")
def window_grid_fill(spark: SparkSession, d: str) -> DataFrame:
    """Window statistics with a row for every empty window as well."""
    rows = S.fill_windows(S.window_statistics(beats(spark, d), ["rec_id"], "sec", FEATURES, WIDTH), ["rec_id"], FEATURES)
    return rows.select("rec_id", "window_no", "feature", "n", "n_null", rounded("avg").alias("avg"))


@query(f"""WITH {BEATS_SQL} SELECT rec_id, floor(sec / 300)::BIGINT AS window_no, {', '.join(f'count(*) FILTER (sleep_stages = {-k}) AS n_{k}' for k in range(6))},
count(*) FILTER (sleep_stages IS NULL OR sleep_stages NOT IN (0, -1, -2, -3, -4, -5)) AS n_other FROM beats WHERE sec IS NOT NULL GROUP BY ALL""")
def window_category_counts(spark: SparkSession, d: str) -> DataFrame:
    """Beats of each stage in windows of 300 s."""
    rows = S.window_categories(beats(spark, d), ["rec_id"], "sec", "sleep_stages", [0, -1, -2, -3, -4, -5], WIDTH)
    return rows.select("rec_id", "window_no", F.col("n_0"), *(F.col(f"`n_-{k}`").alias(f"n_{k}") for k in range(1, 6)), "n_other")


@query(f"""WITH {EPOCHS_SQL}, m AS (SELECT *, epoch_no // 40 AS window_no, CASE WHEN lag(epoch_no) OVER w IS NULL OR stage IS DISTINCT FROM lag(stage) OVER w THEN 1 ELSE 0 END AS b FROM ep WINDOW w AS (PARTITION BY rec_id, epoch_no // 40 ORDER BY epoch_no)),
n AS (SELECT *, sum(b) OVER (PARTITION BY rec_id, window_no ORDER BY epoch_no) AS run FROM m), r AS (SELECT rec_id, window_no, run, any_value(stage) AS stage, count(*) AS n FROM n GROUP BY ALL)
SELECT rec_id, window_no::BIGINT AS window_no, string_agg(coalesce(stage::VARCHAR, '-'), ' ' ORDER BY run) AS states, string_agg(n::VARCHAR, ' ' ORDER BY run) AS lengths FROM r GROUP BY ALL""")
def window_runs(spark: SparkSession, d: str) -> DataFrame:
    """Run-length code of the stages in windows of 40 epochs, as text."""
    rows = S.window_runs(epochs(spark, d), ["rec_id"], "epoch_no", "stage", 40)
    text = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), " ").alias(c)
    return rows.select("rec_id", "window_no", text("states"), text("lengths"))


@query(f"""WITH {BEATS_SQL}, f AS (SELECT *, floor(sec / 300)::BIGINT AS window_no, row_number() OVER (PARTITION BY rec_id, floor(sec / 300) ORDER BY sec, beat_no, area NULLS FIRST) AS place FROM beats WHERE sec IS NOT NULL)
SELECT rec_id, window_no, round(area, 6) AS first_value FROM f WHERE place = 1""")
def first_in_window(spark: SparkSession, d: str) -> DataFrame:
    """First area of each window of 300 s."""
    rows = S.first_in_window(beats(spark, d), ["rec_id"], "sec", "beat_no", "area", WIDTH)
    return rows.select("rec_id", "window_no", rounded("first_value").alias("first_value"))


@query(f"WITH {EPOCHS_SQL} SELECT rec_id, (epoch_no // 30)::BIGINT AS epoch, {', '.join(f'round(avg(coalesce((stage = {k})::INT, 0)), 6) AS share_{k}' for k in range(6))} FROM ep GROUP BY ALL")
def epoch_fractions(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the stages in stretches of 30 epochs."""
    rows = S.epoch_fractions(epochs(spark, d), ["rec_id"], "epoch_no", "stage", list(range(6)), 30)
    return rows.select("rec_id", "epoch", *(rounded(f"share_{k}").alias(f"share_{k}") for k in range(6)))


@query(f"""WITH {BEATS_SQL}, {MERGED_SQL}, ok AS (SELECT rec_id, sec, sec_valley_2_valley AS v FROM beats WHERE sec IS NOT NULL AND NOT EXISTS
  (SELECT 1 FROM merged m WHERE m.rec_id = beats.rec_id AND round(sec * 1000) BETWEEN m.s AND m.e))
SELECT rec_id, floor(sec / 300)::BIGINT AS window_no, count(*) AS n, round(avg(v), 6) AS avg, round(median(v), 6) AS med, CASE WHEN count(v) = 1 THEN 0 ELSE round(regr_slope(v, sec), 6) END AS slope FROM ok GROUP BY ALL""")
def clean_window_stats(spark: SparkSession, d: str) -> DataFrame:
    """Beat interval statistics in windows of 300 s, without the beats inside markings."""
    own = beats(spark, d).where("sec is not null").withColumn("at", F.round(F.col("sec") * 1000).cast("bigint"))
    clean = I.points_in_intervals(own, I.merge_overlaps(markings(spark, d), ["rec_id"], "s", "e"), ["rec_id"], "at", "s", "e", cell=60000, keep="outside")
    rows = S.window_statistics(clean, ["rec_id"], "sec", ["sec_valley_2_valley"], WIDTH)
    return rows.select("rec_id", "window_no", "n", *(rounded(c).alias(c) for c in ("avg", "med", "slope")))


@query(f"WITH {BEATS_SQL}, c AS (SELECT rec_id, seg_id, sleep_stages AS v, count(*) AS n FROM beats WHERE sleep_stages IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY rec_id, seg_id ORDER BY n DESC, v) AS place FROM c) SELECT rec_id, seg_id, v AS stage FROM r WHERE place = 1")
def mode_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent stage of each segment's beats; ties go to the smallest code."""
    return S.smallest_mode(beats(spark, d), SEG, "sleep_stages", "stage")


@query(f"WITH {BEATS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY rec_id, seg_id ORDER BY area DESC NULLS LAST, beat_no) AS place FROM beats) SELECT rec_id, seg_id, beat_no, round(area, 6) AS area, place::INT AS place FROM r WHERE place <= 2")
def top2(spark: SparkSession, d: str) -> DataFrame:
    """The two beats of each segment with the largest area."""
    return S.top_rows(beats(spark, d), SEG, "area", "beat_no", 2).select(*SEG, "beat_no", rounded("area").alias("area"), "place")


@query(f"WITH {BEATS_SQL} SELECT rec_id, seg_id, min(CASE WHEN error_ppg_segmentation THEN beat_no END) AS first_bad, max(CASE WHEN error_ppg_segmentation THEN beat_no END) AS last_bad FROM beats GROUP BY ALL")
def first_last_index(spark: SparkSession, d: str) -> DataFrame:
    """First and last badly segmented beat of each segment."""
    bad = F.when(F.col("error_ppg_segmentation"), F.col("beat_no"))
    return beats(spark, d).groupBy(*SEG).agg(F.min(bad).alias("first_bad"), F.max(bad).alias("last_bad"))


@query(f"WITH {BEATS_SQL} SELECT rec_id, round(median(area), 6) AS median_area FROM beats WHERE area IS NOT NULL GROUP BY rec_id")
def median_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Exact median area of each recording."""
    rows = exact_median(beats(spark, d), ["rec_id"], F.col("area"), "median_area")
    return rows.select("rec_id", rounded("median_area").alias("median_area"))


@query(f"WITH {BEATS_SQL} SELECT rec_id, seg_id, beat_no, 'area' AS feature, round(area, 6) AS value FROM beats UNION ALL SELECT rec_id, seg_id, beat_no, 'sec_valley_2_valley', round(sec_valley_2_valley, 6) FROM beats UNION ALL SELECT rec_id, seg_id, beat_no, 'idx_systolic', idx_systolic FROM beats")
def unpivot_features(spark: SparkSession, d: str) -> DataFrame:
    """Features in long form."""
    rows = S.unpivot(beats(spark, d), [*SEG, "beat_no"], ["area", "sec_valley_2_valley", "idx_systolic"])
    return rows.select(*SEG, "beat_no", "feature", rounded("value").alias("value"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY user_id")
def pivot_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events of three types by user, one column each."""
    counts = load(spark, d, "events").select("user_id", "event_type").groupBy("user_id").pivot("event_type", ["click", "purchase", "error"]).count()
    return counts.fillna(0, ["click", "purchase", "error"])


@query("SELECT rec_id, seg_id FROM r_peak UNION SELECT rec_id, seg_id FROM beat_pair")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "r_peak").select(*SEG).union(load(spark, d, "beat_pair").select(*SEG)).distinct()


@query("SELECT rec_id, seg_id FROM r_peak INTERSECT SELECT rec_id, seg_id FROM ppg_valley")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "r_peak").select(*SEG).intersect(load(spark, d, "ppg_valley").select(*SEG))


@query("SELECT rec_id, seg_id FROM r_peak EXCEPT SELECT rec_id, seg_id FROM beat_pair")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "r_peak").select(*SEG).subtract(load(spark, d, "beat_pair").select(*SEG))


@query("SELECT rec_id, seg_id, idx FROM r_peak WHERE (rec_id, seg_id) IN (SELECT rec_id, seg_id FROM beat_pair)")
def set_member(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "r_peak").join(load(spark, d, "beat_pair").select(*SEG), SEG, "left_semi").select(*SEG, "idx")


@query("SELECT p_partkey, p_name FROM part WHERE contains(upper(p_name), 'RED')")
def label_projection(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose name contains a label, whatever its case."""
    return load(spark, d, "part").where(F.upper("p_name").contains("RED")).select("p_partkey", "p_name")


@query("SELECT rec_id, regexp_extract(rec_id, '(\\d+)_(\\d+)', 1) AS subject, strptime(regexp_extract(rec_id, '(\\d+)_(\\d+)', 2), '%Y%m%d')::DATE AS day, regexp_replace(dataset, '[aeiou]', '', 'g') AS short_name, start_ts::DATE AS start_day FROM recording")
def id_regex(spark: SparkSession, d: str) -> DataFrame:
    """Subject and day from a recording's id."""
    pattern = r"(\d+)_(\d+)"
    return load(spark, d, "recording").select(
        "rec_id",
        F.regexp_extract("rec_id", pattern, 1).alias("subject"),
        F.try_to_timestamp(F.regexp_extract("rec_id", pattern, 2), F.lit("yyyyMMdd")).cast("date").alias("day"),
        F.regexp_replace("dataset", "[aeiou]", "").alias("short_name"),
        F.col("start_ts").cast("date").alias("start_day"),
    )


@query("SELECT dataset, count(*) AS n, CASE dataset WHEN 'alder' THEN 'A' WHEN 'birch' THEN 'B' WHEN 'cedar' THEN 'C' ELSE 'other' END AS code FROM recording GROUP BY dataset")
def config_map(spark: SparkSession, d: str) -> DataFrame:
    """Codes of datasets from a map with a default."""
    names = F.create_map(*(F.lit(x) for x in ("alder", "A", "birch", "B", "cedar", "C")))
    return load(spark, d, "recording").groupBy("dataset").agg(F.count("*").alias("n")).withColumn("code", F.coalesce(F.try_element_at(names, F.col("dataset")), F.lit("other")))


@query(f"WITH {signal_sql('ecg')} SELECT rec_id, seg_id, idx, round(degrees(atan(value)), 5) AS angle, round(sign(value) * sqrt(abs(value)), 5) AS root, idx % 7 AS rest FROM sig WHERE value IS NOT NULL")
def numeric_functions(spark: SparkSession, d: str) -> DataFrame:
    """Angles, roots and remainders of ECG samples."""
    v = F.col("value")
    rows = signal(spark, d, "ecg").where("value is not null")
    return rows.select(*SEG, "idx", rounded(F.degrees(F.atan(v)), 5).alias("angle"), rounded(F.signum(v) * F.sqrt(F.abs(v)), 5).alias("root"), (F.col("idx") % 7).alias("rest"))


@query("SELECT DISTINCT rec_id, seg_id, len(sleep_stages) AS n, round(list_sum(sleep_stages[1:3]), 3) AS head, round(list_reverse(sleep_stages)[1], 3) AS last_one FROM segment WHERE len(list_filter(sleep_stages, lambda x: x IS NULL OR isnan(x))) = 0")
def array_functions(spark: SparkSession, d: str) -> DataFrame:
    """Slices, reversals and sums of the stage arrays without missing stages."""
    stages = F.col("sleep_stages")
    whole = load(spark, d, "segment").where(~F.exists(stages, lambda x: x.isNull() | F.isnan(x))).select(*SEG, "sleep_stages").dropDuplicates(SEG)
    return whole.select(
        *SEG,
        F.size(stages).cast("bigint").alias("n"),
        rounded(F.aggregate(F.slice(stages, 1, 3), F.lit(0.0), lambda a, x: a + x), 3).alias("head"),
        rounded(F.try_element_at(F.reverse(stages), F.lit(1)), 3).alias("last_one"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
