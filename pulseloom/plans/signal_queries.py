"""Registered queries of the moving-frame, detection and template operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.functions.common import load
from pulseloom.operators import beats as E
from pulseloom.operators import channels as C
from pulseloom.operators import detect as D
from pulseloom.operators import moving as V
from pulseloom.operators import noise as N
from pulseloom.operators import templates as T
from pulseloom.plans.views import BEATS_SQL, SEG, WAVES_SQL, beats, channel_arrays, events_of, events_sql, rounded, signal, signal_sql, waves

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SIG = f"WITH {signal_sql('po')}"
W = "WINDOW w AS (PARTITION BY rec_id, seg_id ORDER BY idx)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _kept(df: DataFrame, *columns: str) -> DataFrame:
    """Key and position with rounded results."""
    return df.select(*SEG, "idx", *(rounded(c).alias(c) for c in columns))


def frame_sql(expression: str, low: int, high: int) -> str:
    side = lambda k: f"{abs(k)} {'PRECEDING' if k <= 0 else 'FOLLOWING'}"
    return f"{expression} OVER (PARTITION BY rec_id, seg_id ORDER BY idx RANGE BETWEEN {side(low)} AND {side(high)})"


@query(f"{SIG} SELECT rec_id, seg_id, idx, round({frame_sql('avg(value)', -10, 10)}, 6) AS moving_mean FROM sig")
def moving_mean_odd(spark: SparkSession, d: str) -> DataFrame:
    return _kept(C.moving_mean(channel_arrays(spark, d), SEG, "x", 21), "moving_mean")


@query(f"{SIG} SELECT rec_id, seg_id, idx, round({frame_sql('avg(value)', -32, 31)}, 6) AS moving_mean FROM sig")
def moving_mean_even(spark: SparkSession, d: str) -> DataFrame:
    return _kept(C.moving_mean(channel_arrays(spark, d), SEG, "x", 64), "moving_mean")


@query(f"{SIG} SELECT rec_id, seg_id, idx, round({frame_sql('stddev_samp(value)', -16, 15)}, 6) AS moving_std FROM sig")
def moving_std(spark: SparkSession, d: str) -> DataFrame:
    return _kept(V.moving_std(signal(spark, d), SEG, "idx", "value", 32), "moving_std")


def smooth_sql(width: int, passes: int) -> str:
    h = width // 2
    parts, source = [], "value"
    for k in range(passes):
        table = "sig" if k == 0 else f"s{k - 1}"
        if width % 2:
            total, weight = frame_sql(f"sum({source})", -h, h), frame_sql(f"count({source})", -h, h)
        else:
            total = f"(coalesce({frame_sql(f'sum({source})', -h, h - 1)}, 0) + coalesce({frame_sql(f'sum({source})', 1 - h, h)}, 0)) / 2"
            weight = f"({frame_sql(f'count({source})', -h, h - 1)} + {frame_sql(f'count({source})', 1 - h, h)}) / 2"
        parts.append(f"s{k} AS (SELECT rec_id, seg_id, idx, value, CASE WHEN {weight} >= {max(width * 0.5, 1)} THEN ({total}) / ({weight}) END AS smooth FROM {table})")
        source = "smooth"
    return ", ".join(parts)


for _name, _width, _passes in (("boxcar_1", 7, 1), ("boxcar_2", 8, 2), ("boxcar_3", 31, 3)):

    def _boxcar(spark: SparkSession, d: str, width: int = _width, passes: int = _passes) -> DataFrame:
        rows = C.smooth(channel_arrays(spark, d), SEG, "x", width, passes)
        return _kept(rows.withColumn("smooth", F.col("smooth") + 3e-9), "smooth")  # off the ties of held values

    QUERIES[_name] = _boxcar
    SQL[_name] = f"{SIG}, {smooth_sql(_width, _passes)} SELECT rec_id, seg_id, idx, round(smooth + 3e-9, 6) AS smooth FROM s{_passes - 1}"


@query(f"""{SIG}, s AS (SELECT *, lead(value) OVER w - value AS d FROM sig {W})
SELECT rec_id, seg_id, idx, round((d * 2 + coalesce(lag(d) OVER w, 0) * 2 + coalesce(lag(d, 2) OVER w, 0) + coalesce(lead(d) OVER w, 0)) / 6, 6) AS slope FROM s {W}""")
def four_point_slope(spark: SparkSession, d: str) -> DataFrame:
    return _kept(V.four_point_slope(signal(spark, d), SEG, "idx", "value"), "slope")


@query(f"{SIG} SELECT rec_id, seg_id, idx, CASE WHEN idx >= 21 THEN round({frame_sql('sum(coalesce(value, 0))', -21, 0)}, 6) END AS window_sum FROM sig")
def prefix_window_sum(spark: SparkSession, d: str) -> DataFrame:
    return _kept(V.window_sum(signal(spark, d), SEG, "idx", "value", 22), "window_sum")


@query(f"""{SIG}, s AS (SELECT *, lead(value) OVER w - value AS d FROM sig {W}) SELECT rec_id, seg_id, idx, round({frame_sql('avg(d)', 0, 6)}, 6) AS rolling_slope FROM s""")
def rolling_slope(spark: SparkSession, d: str) -> DataFrame:
    return _kept(C.rolling_slope(channel_arrays(spark, d), SEG, "x", 7), "rolling_slope")


@query(f"{SIG} SELECT rec_id, seg_id, idx, round(value, 6) AS lag0, round(lag(value) OVER w, 6) AS lag1, round(lag(value, 2) OVER w, 6) AS lag2, round(lag(value, 3) OVER w, 6) AS lag3 FROM sig {W}")
def rolling_lags(spark: SparkSession, d: str) -> DataFrame:
    rows = V.lagged(signal(spark, d), SEG, "idx", "value", 4)
    return _kept(rows.withColumns({f"lag{k}": F.col("lagged")[k] for k in range(4)}), *(f"lag{k}" for k in range(4)))


def polynomial_sql(weights: list[float]) -> str:
    half = len(weights) // 2
    near = lambda k: "value" if k == 0 else f"{'lead' if k > 0 else 'lag'}(value, {abs(k)}) OVER w"
    return " + ".join(f"({near(k - half)}) * ({w!r})" for k, w in enumerate(weights))


@query(f"{SIG} SELECT rec_id, seg_id, idx, round({polynomial_sql(V.polynomial_weights(3, 11))}, 5) AS smooth FROM sig {W}")
def polynomial_smooth(spark: SparkSession, d: str) -> DataFrame:
    rows = V.polynomial_smooth(signal(spark, d), SEG, "idx", "value", 3, 11)
    return rows.select(*SEG, "idx", rounded("smooth", 5).alias("smooth"))


@query(f"{SIG} SELECT rec_id, seg_id, idx, round(({polynomial_sql(V.polynomial_weights(3, 11, 1))}), 5) AS slope FROM sig {W}")
def polynomial_slope(spark: SparkSession, d: str) -> DataFrame:
    rows = V.polynomial_smooth(signal(spark, d), SEG, "idx", "value", 3, 11, derivative=1, out="slope")
    return rows.select(*SEG, "idx", rounded("slope", 5).alias("slope"))


@query(f"""{SIG}, l AS (SELECT *, list_sort(list_filter({frame_sql('list(value)', -20, 20)}, lambda x: x IS NOT NULL)) AS f FROM sig),
m AS (SELECT *, f[(floor(len(f) * 0.375) + 1)::INT:greatest(ceil(len(f) * 0.625), floor(len(f) * 0.375) + 1)::INT] AS mid FROM l)
SELECT rec_id, seg_id, idx, round(value - list_sum(mid) / len(mid), 6) AS residual FROM m""")
def middle_mean_residual(spark: SparkSession, d: str) -> DataFrame:
    return _kept(C.middle_mean_residual(channel_arrays(spark, d), SEG, "x", 20), "residual")


@query(f"{SIG} SELECT rec_id, seg_id, idx, round(coalesce(value, {frame_sql('median(value)', -19, 0)}), 6) AS filled FROM sig")
def trailing_median_fill(spark: SparkSession, d: str) -> DataFrame:
    return _kept(C.fill_with_trailing_median(channel_arrays(spark, d), SEG, "x", 20), "filled")


@query(f"{SIG} SELECT rec_id, seg_id, idx, round(last_value(CASE WHEN value >= -0.5 THEN value END IGNORE NULLS) OVER (PARTITION BY rec_id, seg_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 6) AS filled FROM sig")
def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    return _kept(C.fill_forward(channel_arrays(spark, d), SEG, "x", missing_below=-0.5), "filled")


for _direction, _test in (("both", "abs(off) > b"), ("upper", "off > b"), ("lower", "off < -b")):

    def _steps(spark: SparkSession, d: str, direction: str = _direction) -> DataFrame:
        return C.step_outliers(channel_arrays(spark, d), SEG, "x", 2.5, 100, direction)

    QUERIES[f"std_outlier_{_direction}"] = _steps
    SQL[f"std_outlier_{_direction}"] = f"""{SIG}, s AS (SELECT *, lead(value) OVER w - value AS d FROM sig {W}),
b AS (SELECT *, d - {frame_sql('avg(d)', -50, 49)} AS off, 2.5 * stddev_samp(d) OVER (PARTITION BY rec_id, seg_id) AS b FROM s),
x AS (SELECT *, coalesce({_test}, false) AS wrong FROM b), y AS (SELECT *, wrong OR coalesce(lag(wrong) OVER w, false) AS outlier FROM x {W})
SELECT rec_id, seg_id, idx FROM y WHERE outlier"""


@query(f"""WITH {BEATS_SQL}, m AS (SELECT *, median(sec_valley_2_valley) OVER (PARTITION BY rec_id) AS mid FROM beats),
a AS (SELECT *, median(abs(sec_valley_2_valley - mid)) OVER (PARTITION BY rec_id) AS mad FROM m)
SELECT rec_id, seg_id, beat_no FROM a WHERE abs(sec_valley_2_valley - mid) > mad * 1.4826 * 3""")
def mad_outlier(spark: SparkSession, d: str) -> DataFrame:
    """Beat intervals far from the recording's median."""
    return V.mad_outliers(beats(spark, d), ["rec_id"], "sec_valley_2_valley").where("outlier").select(*SEG, "beat_no")


@query(f"{SIG} SELECT rec_id, seg_id, idx // 250 AS window_no, count(value) AS n, round(max(value) - min(value), 6) AS height FROM sig GROUP BY ALL")
def ampogram(spark: SparkSession, d: str) -> DataFrame:
    rows = V.ampogram(signal(spark, d), SEG, "idx", "value", 250)
    return rows.select(*SEG, "window_no", "n", rounded("height").alias("height"))


@query(f"""{SIG}, u AS (SELECT rec_id, seg_id, idx, value, idx // 250 AS window_no FROM sig UNION ALL SELECT rec_id, seg_id, idx, value, (idx + 1) // 250 FROM sig WHERE (idx + 1) // 250 <> idx // 250)
SELECT rec_id, seg_id, window_no, count(value) AS n, round(max(value) - min(value), 6) AS height FROM u GROUP BY ALL""")
def ampogram_shared(spark: SparkSession, d: str) -> DataFrame:
    rows = V.ampogram(signal(spark, d), SEG, "idx", "value", 250, edges="shared")
    return rows.select(*SEG, "window_no", "n", rounded("height").alias("height"))


@query(f"WITH {signal_sql('ecg')} SELECT rec_id, seg_id, stddev_samp(value) IS NULL OR stddev_samp(value) = 0 AS is_flat, count(value) AS n FROM sig GROUP BY ALL")
def flat_group_filter(spark: SparkSession, d: str) -> DataFrame:
    """Whether a segment's ECG is flat."""
    std = F.stddev_samp("value")
    return signal(spark, d, "ecg").groupBy(*SEG).agg((std.isNull() | (std == 0)).alias("is_flat"), F.count("value").alias("n"))


@query()
def automatic_noise(spark: SparkSession, d: str) -> DataFrame:
    """Noise intervals of each segment's pulse wave: windows of unusual height and flat stretches, joined and widened."""
    found = N.automatic_noise(signal(spark, d), SEG, "idx", "value", window=250, flat=60, join=125, widen=50)
    return found.select(*SEG, "low", "high")


@query(f"{SIG} SELECT rec_id, seg_id, idx, round(value, 6) AS value FROM (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM sig {W}) WHERE value > a AND value >= b")
def local_maxima(spark: SparkSession, d: str) -> DataFrame:
    return _kept(D.local_maxima(signal(spark, d), SEG, "idx", "value"), "value")


TALL = f"WITH {signal_sql('ecg')}, q AS (SELECT *, value * value AS score FROM sig), t AS (SELECT rec_id, seg_id, avg(score) + 2 * stddev_samp(score) AS least FROM q GROUP BY ALL)"


@query(TALL + " SELECT rec_id, seg_id, idx, round(score, 6) AS score FROM q JOIN t USING (rec_id, seg_id) WHERE score > least")
def threshold_peaks(spark: SparkSession, d: str) -> DataFrame:
    """ECG samples whose square is two deviations above the mean."""
    return _kept(D.tall_samples(signal(spark, d, "ecg"), SEG, F.col("value") * F.col("value"), 2.0), "score")


@query()
def thinned_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Local maxima of the pulse wave, tallest first, at least 40 samples apart."""
    return _kept(D.thin_peaks(D.local_maxima(signal(spark, d), SEG, "idx", "value").select(*SEG, "idx", "value"), SEG, "idx", "value", 40), "value")


@query(f"""WITH {signal_sql('ecg')}, {events_sql('r_peak', 'p')}, j AS (SELECT p.rec_id, p.seg_id, p.idx, s.idx AS snapped, s.value,
  row_number() OVER (PARTITION BY p.rec_id, p.seg_id, p.idx ORDER BY s.value DESC, s.idx) AS place FROM p JOIN sig s ON p.rec_id = s.rec_id AND p.seg_id = s.seg_id
  AND abs(p.idx - s.idx) <= 20 AND s.value IS NOT NULL) SELECT rec_id, seg_id, idx, snapped, round(value, 6) AS value FROM j WHERE place = 1""")
def snap_to_local_max(spark: SparkSession, d: str) -> DataFrame:
    """R peaks inside the ECG excerpts moved to the tallest sample nearby."""
    rows = D.snap_to_maximum(events_of(spark, d, "r_peak"), signal(spark, d, "ecg"), SEG, "idx", "value", 20)
    return rows.select(*SEG, "idx", "snapped", rounded("value").alias("value"))


VOTES = f"""WITH {BEATS_SQL}, {events_sql('ppg_valley', 'v')}, b0 AS (SELECT DISTINCT rec_id, seg_id, ppg_begin FROM segment WHERE ppg_begin IS NOT NULL),
votes0 AS (SELECT rec_id, seg_id, idx, 1.5 AS weight, 2.0 AS height FROM v UNION ALL SELECT DISTINCT rec_id, seg_id, ppg_idx, 0.75, 1.0 FROM beat_pair WHERE ppg_idx >= 0
  UNION ALL SELECT DISTINCT b.rec_id, b.seg_id, idx_begin - ppg_begin, 1.25, 3.0 FROM beats b JOIN b0 USING (rec_id, seg_id) WHERE idx_begin IS NOT NULL)"""


def _votes(spark: SparkSession, d: str) -> DataFrame:
    begins = load(spark, d, "segment").where("ppg_begin is not null").select(*SEG, "ppg_begin").distinct()
    own = beats(spark, d).where("idx_begin is not null").join(begins, SEG).select(*SEG, (F.col("idx_begin") - F.col("ppg_begin")).alias("idx")).distinct()
    parts = (
        (events_of(spark, d, "ppg_valley").select(*SEG, "idx"), 1.5, 2.0),
        (load(spark, d, "beat_pair").where("ppg_idx >= 0").select(*SEG, F.col("ppg_idx").alias("idx")).distinct(), 0.75, 1.0),
        (own, 1.25, 3.0),
    )
    votes = [p.withColumns({"weight": F.lit(w), "height": F.lit(h)}) for p, w, h in parts]
    return votes[0].unionByName(votes[1]).unionByName(votes[2])


@query(VOTES + """, f AS (SELECT *, CASE WHEN idx - lag(idx) OVER w <= 5 THEN 0 ELSE 1 END AS far FROM votes0 WINDOW w AS (PARTITION BY rec_id, seg_id ORDER BY idx)),
g AS (SELECT *, sum(far) OVER (PARTITION BY rec_id, seg_id ORDER BY idx RANGE UNBOUNDED PRECEDING) AS c FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY rec_id, seg_id, c ORDER BY height DESC, idx) AS place, sum(weight) OVER (PARTITION BY rec_id, seg_id, c) AS votes FROM g)
SELECT rec_id, seg_id, idx, height::DOUBLE AS height, round(votes, 6)::DOUBLE AS votes FROM r WHERE place = 1 AND votes >= 2.4""")
def weighted_vote_islands(spark: SparkSession, d: str) -> DataFrame:
    """Beat begins on which the valley list, the feature rows and an earlier pairing agree by weight."""
    rows = D.weighted_vote(_votes(spark, d), SEG, "idx", "weight", "height", reach=5, least=2.4)
    return rows.select(*SEG, "idx", "height", rounded("votes").alias("votes"))


EXTREMA = f"""{SIG}, {smooth_sql(31, 3)}, lv AS (SELECT *, {frame_sql('avg(smooth)', -62, 62)} AS level FROM s2),
mk AS (SELECT rec_id, seg_id, idx, value, smooth > level AS up FROM lv WHERE smooth IS NOT NULL AND level IS NOT NULL AND value IS NOT NULL),
bg AS (SELECT *, CASE WHEN up = lag(up) OVER w THEN 0 ELSE 1 END AS b FROM mk {W}), rn AS (SELECT *, sum(b) OVER (PARTITION BY rec_id, seg_id ORDER BY idx)::BIGINT AS run_no FROM bg),
tp AS (SELECT *, row_number() OVER (PARTITION BY rec_id, seg_id, run_no ORDER BY CASE WHEN up THEN value ELSE -value END DESC, idx) AS place FROM rn)"""


def extrema(channels: DataFrame) -> DataFrame:
    """Valleys and peaks of pulse wave arrays ``x``, with frames of 31 and 125 samples."""
    own = channels.withColumns({"soft": F.lit(31), "wide": F.lit(125)})
    return C.pulse_valleys_and_peaks(own, SEG, "x", smooth_width="soft", mean_width="wide")


@query(EXTREMA + " SELECT rec_id, seg_id, run_no, CASE WHEN up THEN 'peak' ELSE 'valley' END AS kind, idx, round(value, 6) AS value FROM tp WHERE place = 1")
def mask_run_extrema(spark: SparkSession, d: str) -> DataFrame:
    """Valleys and peaks of the pulse wave."""
    return extrema(channel_arrays(spark, d)).select(*SEG, "run_no", "kind", "idx", rounded("value").alias("value"))


@query(f"""WITH {signal_sql('ecg')}, a AS (SELECT *, coalesce(pow(lead(value) OVER w - value, 2), 0) AS e FROM sig {W}),
b AS (SELECT *, CASE WHEN idx >= 6 THEN {frame_sql('sum(e)', -6, 0)} END AS s FROM a), c AS (SELECT *, coalesce(s > 0.2 * max(s) OVER (PARTITION BY rec_id, seg_id), false) AS is_on FROM b),
g AS (SELECT *, CASE WHEN is_on AND NOT coalesce(lag(is_on) OVER w, false) THEN 1 ELSE 0 END AS begins FROM c {W}),
h AS (SELECT *, sum(begins) OVER (PARTITION BY rec_id, seg_id ORDER BY idx)::BIGINT AS region FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY rec_id, seg_id, region ORDER BY value DESC NULLS LAST, idx) AS place, min(idx) OVER (PARTITION BY rec_id, seg_id, region) AS low,
  max(idx) OVER (PARTITION BY rec_id, seg_id, region) AS high FROM h WHERE is_on)
SELECT rec_id, seg_id, region, low, high, idx, round(value, 6) AS value FROM k WHERE place = 1""")
def energy_regions(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of high slope energy of the ECG and their tallest sample."""
    return D.energy_regions(signal(spark, d, "ecg"), SEG, "idx", "value").select(*SEG, "region", "low", "high", "idx", rounded("value").alias("value"))


@query(f"{SIG}, sl AS (SELECT rec_id, seg_id, idx, {polynomial_sql(V.polynomial_weights(3, 11, 1))} AS g FROM sig {W}) SELECT rec_id, seg_id, idx, round(pow(greatest(g, 0), 2), 5) AS energy FROM sl WHERE g IS NOT NULL")
def rising_energy(spark: SparkSession, d: str) -> DataFrame:
    """Square of the rising smoothed slope of the pulse wave."""
    rows = V.rising_energy(signal(spark, d), SEG, "idx", "value").where("energy is not null")
    return rows.select(*SEG, "idx", rounded("energy", 5).alias("energy"))


@query()
def detrended(spark: SparkSession, d: str) -> DataFrame:
    """Pulse wave excerpts without their slow trend, one row a sample."""
    rows = D.detrend_channels(load(spark, d, "segment").select(*SEG, "po", "ppg_rate").where(F.size("po") > 1).dropDuplicates(SEG), SEG, "po", "ppg_rate")
    return rows.select(*SEG, F.posexplode("po").alias("idx", "x")).select(*SEG, "idx", rounded("x").alias("value"))


ONSETS = f"""{SIG}, a AS (SELECT *, greatest(coalesce(value - lag(value) OVER w, 0), 0) AS rise FROM sig {W}), b AS (SELECT *, round({frame_sql('sum(rise)', -15, 0)}, 9) AS s,
  {frame_sql('min(CASE WHEN value IS NOT NULL THEN row(value, idx) END)', -16, 0)} AS low FROM a), c AS (SELECT *, lag(s) OVER w AS before, round(avg(s) OVER (PARTITION BY rec_id, seg_id) * 0.6, 9) AS least FROM b {W})"""


@query(ONSETS + " SELECT rec_id, seg_id, low[2] AS onset, idx AS crossing FROM c WHERE s > least AND before <= least")
def slope_sum_onsets(spark: SparkSession, d: str) -> DataFrame:
    """Pulse onsets by the slope sum."""
    return D.slope_sum_onsets(signal(spark, d), SEG, "idx", "value", width=16)


@query()
def regular_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of good pulse wave by the regularity of its variation."""
    return D.regular_spans(signal(spark, d), SEG, "idx", "value", short=250, long=1250, low=0.001, high=0.2, patch=125, least=500, most=1000)


@query()
def band_passed(spark: SparkSession, d: str) -> DataFrame:
    """ECG excerpts in the band from 5 to 15 Hz, one row a sample."""
    rows = D.filter_channels(load(spark, d, "segment").select(*SEG, "ecg", "ecg_rate").where(F.size("ecg") > 1).dropDuplicates(SEG), SEG, "ecg", "ecg_rate", (5.0, 15.0))
    return rows.select(*SEG, F.posexplode("ecg").alias("idx", "x")).select(*SEG, "idx", rounded("x").alias("filtered"))


@query(f"""{SIG}, s AS (SELECT *, lead(value) OVER w - value AS d FROM sig {W}), r AS (SELECT *, row_number() OVER (PARTITION BY rec_id, seg_id ORDER BY d DESC, idx) AS up,
row_number() OVER (PARTITION BY rec_id, seg_id ORDER BY d, idx) AS down FROM s WHERE d IS NOT NULL)
SELECT rec_id, seg_id, max(CASE WHEN up = 1 THEN idx END) AS rise_at, round(max(d), 6) AS rise, max(CASE WHEN down = 1 THEN idx END) AS fall_at, round(min(d), 6) AS fall FROM r GROUP BY ALL""")
def steepest_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steepest rise and fall of each segment's pulse wave."""
    return D.steepest(signal(spark, d), SEG, "idx", "value").select(*SEG, "rise_at", rounded("rise").alias("rise"), "fall_at", rounded("fall").alias("fall"))


@query(f"""WITH {events_sql('r_peak', 'p')}, g AS (SELECT rec_id, seg_id, sec - lag(sec) OVER (PARTITION BY rec_id, seg_id ORDER BY sec) AS gap FROM p)
SELECT rec_id, seg_id, round(avg(60 / gap), 6) AS heart_rate, count(*) AS n_intervals FROM g WHERE gap > 0 GROUP BY ALL""")
def heart_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = D.heart_rate(events_of(spark, d, "r_peak"), SEG, "sec")
    return rows.select(*SEG, rounded("heart_rate").alias("heart_rate"), "n_intervals")


@query()
def cycle_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every interval between R peaks judged against those accepted before it."""
    return D.label_cycles(events_of(spark, d, "r_peak"), SEG, "sec")


@query()
def detected_beats(spark: SparkSession, d: str) -> DataFrame:
    """Beats of all ECG excerpts by the adaptive detector."""
    return D.detect_beats(load(spark, d, "segment"), SEG, "ecg", "ecg_rate")


@query()
def voted_beats(spark: SparkSession, d: str) -> DataFrame:
    """Beats of all ECG excerpts on which the detectors agree by weight."""
    rows = E.voted_beats(channel_arrays(spark, d, "ecg"), SEG, "x", "fs")
    return rows.select(*SEG, "idx", rounded("height").alias("height"), rounded("votes").alias("votes"))


@query(f"WITH {WAVES_SQL} SELECT label, pos::INT AS pos, round(median(value), 6) AS template, count(*) AS n_waves FROM wv GROUP BY ALL")
def template_median(spark: SparkSession, d: str) -> DataFrame:
    """Median wave of each group of embeddings."""
    rows = T.template(waves(spark, d), ["label"], "pos", "value")
    return rows.select("label", "pos", rounded("template").alias("template"), "n_waves")


@query(f"""WITH {WAVES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY value DESC, pos) AS place FROM wv),
a AS (SELECT vec_id, label, pos AS anchor, value AS own FROM r WHERE place = 1), l AS (SELECT label, avg(own) AS level FROM a GROUP BY label)
SELECT w.label, w.vec_id, (w.pos - anchor)::INT AS aligned_offset, round(w.value - own + level, 6) AS aligned FROM wv w JOIN a USING (vec_id) JOIN l ON w.label = l.label""")
def align_shift(spark: SparkSession, d: str) -> DataFrame:
    """Waves aligned at their tallest sample."""
    top = F.max(F.struct("value", (-F.col("pos")).alias("p"))).over(Window.partitionBy("vec_id"))
    rows = T.align_waves(waves(spark, d).withColumn("anchor", -top["p"]), ["label"], "vec_id", "pos", "value", "anchor")
    return rows.select("label", "vec_id", "aligned_offset", rounded("aligned").alias("aligned"))


@query(f"""WITH {WAVES_SQL}, o AS (SELECT *, abs(value - avg(value) OVER w) / stddev_samp(value) OVER w AS off FROM wv WINDOW w AS (PARTITION BY label, pos))
SELECT label, vec_id, round(avg(CASE WHEN off > 2.5 THEN 1 ELSE 0 END + CASE WHEN off > 3 THEN 3 ELSE 0 END + CASE WHEN off > 4 THEN 9 ELSE 0 END), 6) AS score FROM o GROUP BY ALL""")
def wave_score(spark: SparkSession, d: str) -> DataFrame:
    """How odd each wave is in its group."""
    return T.wave_scores(waves(spark, d), ["label"], "vec_id", "pos", "value").select("label", "vec_id", rounded("score").alias("score"))


@query(f"""WITH {WAVES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY value DESC, pos) AS place FROM wv),
s AS (SELECT label, vec_id, count(*) AS n, max(value) AS h, max(CASE WHEN place = 1 THEN pos END) AS top_at FROM r GROUP BY ALL),
t AS (SELECT label, median(n) AS nm, stddev_samp(n) AS ns, avg(h) AS hm, stddev_samp(h) AS hs, avg(top_at) AS am, stddev_samp(top_at) AS asd FROM s GROUP BY label)
SELECT DISTINCT label, vec_id FROM s JOIN t USING (label) WHERE abs(n - nm) <= ns * 2.5 AND abs(h - hm) <= hs * 5 AND abs(top_at - am) <= asd * 7.5""")
def good_waves(spark: SparkSession, d: str) -> DataFrame:
    """Waves of usual length, height and peak position."""
    return T.good_waves(waves(spark, d), ["label"], "vec_id", "pos", "value").select("label", "vec_id").distinct()


@query(f"""{SIG}, s AS (SELECT rec_id, seg_id, sum(value) AS total FROM sig GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY seg_id) AS k FROM s)
SELECT a.rec_id, a.seg_id AS first, b.seg_id AS second, round(pow(a.total - b.total, 2), 3) AS difference FROM n a JOIN n b ON a.rec_id = b.rec_id AND b.k > a.k AND b.k <= a.k + 3""")
def neighbour_differences(spark: SparkSession, d: str) -> DataFrame:
    """Summed difference of each segment's pulse wave to the next three of its recording."""
    rows = T.neighbour_differences(signal(spark, d), ["rec_id"], "seg_id", "value", 3)
    return rows.select("rec_id", "first", "second", rounded("difference", 3).alias("difference"))


@query(f"""WITH {WAVES_SQL}, t AS (SELECT label, pos, median(value) AS template FROM wv GROUP BY ALL)
SELECT label, vec_id, round(greatest(corr(value, template), 0), 6) AS correlation FROM wv JOIN t USING (label, pos) GROUP BY ALL HAVING corr(value, template) IS NOT NULL""")
def corr_to_template(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of each wave with its group's median wave."""
    all_ = waves(spark, d)
    rows = T.correlation_to_template(all_, T.template(all_, ["label"], "pos", "value"), ["label"], "vec_id", "pos", "value")
    return rows.select("label", "vec_id", rounded("correlation").alias("correlation"))


@query()
def similarity_to_template(spark: SparkSession, d: str) -> DataFrame:
    """Correlation, warping and Frechet distance of each embedding to its group's median wave."""
    medians = T.template(waves(spark, d), ["label"], "pos", "value")
    whole = medians.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "template"))), lambda s: s["template"]).alias("reference"))  # 64 values
    own = load(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("samples"))
    return T.similarity_to_template(own.join(whole, "label"), ["label", "vec_id"], "samples", "reference")


@query()
def nearest_stretches(spark: SparkSession, d: str) -> DataFrame:
    """The three stretches of each pulse wave excerpt that are most like one steep beat."""
    x = [0.0, 0.05, 0.15, 0.35, 0.6, 0.85, 1.0, 1.0, 0.9, 0.78, 0.68, 0.6, 0.55, 0.5, 0.42, 0.34, 0.27, 0.2, 0.14, 0.09, 0.05, 0.02]
    query_ = [x[i // 4] + (x[min(i // 4 + 1, len(x) - 1)] - x[i // 4]) * (i % 4) / 4 for i in range(4 * len(x))]
    one = load(spark, d, "segment").select(*SEG, "po").where(F.size("po") > 1).dropDuplicates(SEG)
    return T.nearest_stretches(one, SEG, "po", query_, 3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
