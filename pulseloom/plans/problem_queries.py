"""Registered queries of the general data operators: regular grids, implausible readings, interval islands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.functions.common import broadcast_if_small, is_number, latest, load
from pulseloom.operators.control_charts import flag_implausible
from pulseloom.operators.interval_islands import merge_intervals
from pulseloom.operators.regular_grid import regular_grid

SLOT_SEC = 10.0
GAP_LIMIT_SEC = 30.0


def _usable_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = load(spark, sf_dir, "recording").select("rec_id", F.coalesce("ppg_rate", "ecg_rate").alias("ppg_rate"))
    beats = load(spark, sf_dir, "beat_feature").select("rec_id", "seg_id", F.floor(F.col("beat_no") / 65536).alias("part"), "beat_no", "idx_begin", "sec_valley_2_valley", "loaded_at")
    held = latest(beats, ["rec_id", "seg_id", "part", "beat_no"], "loaded_at", partition=["rec_id", "seg_id", "part"])
    interval = F.col("sec_valley_2_valley")
    usable = held.where(F.col("idx_begin").isNotNull() & is_number(interval) & (interval >= 0))
    return usable.join(broadcast_if_small(rates), "rec_id").select("rec_id", "seg_id", (F.col("idx_begin") / F.col("ppg_rate")).alias("sec"), interval.alias("beat_sec"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_series(spark, sf_dir).where("n_readings = 0").select("rec_id", "seg_id", "slot_no")


def p2_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beat interval of each segment every 10 s, with slots marked as observed, filled or gap."""
    return regular_grid(_usable_beats(spark, sf_dir), ["rec_id", "seg_id"], "sec", "beat_sec", SLOT_SEC, gap_limit=GAP_LIMIT_SEC)


P2_SLOTS = """
WITH held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, seg_id, beat_no ORDER BY loaded_at DESC) AS place
    FROM beat_feature) WHERE place = 1 AND idx_begin IS NOT NULL AND sec_valley_2_valley IS NOT NULL
    AND NOT isnan(sec_valley_2_valley) AND sec_valley_2_valley >= 0),
t AS (SELECT rec_id, seg_id, idx_begin / coalesce(ppg_rate, ecg_rate) AS sec, sec_valley_2_valley AS v FROM held JOIN recording USING (rec_id)),
slots AS (SELECT rec_id, seg_id, floor(sec / 10)::BIGINT AS slot, count(*) AS n, avg(v) AS mean,
    min(row(sec, v)) AS f, max(row(sec, v)) AS l FROM t GROUP BY ALL),
near AS (SELECT *, lag(slot) OVER w AS before, lag(l) OVER w AS b FROM slots WINDOW w AS (PARTITION BY rec_id, seg_id ORDER BY slot)),
grid AS (SELECT *, unnest(range(coalesce(before + 1, slot), slot + 1)) AS slot_no FROM near)
"""
P2_FOUND = P2_SLOTS + "SELECT rec_id, seg_id, slot_no FROM grid WHERE slot_no < slot"
P2_SERIES = P2_SLOTS + """, valued AS (SELECT *, CASE WHEN slot_no = slot AND f[1] = slot_no * 10 THEN f[2]
    WHEN f[1] - b[1] <= 30 THEN b[2] + (f[2] - b[2]) * ((slot_no * 10 - b[1]) / (f[1] - b[1])) END AS value FROM grid)
SELECT rec_id, seg_id, slot_no, CASE WHEN slot_no = slot THEN 'observed' WHEN value IS NOT NULL THEN 'filled' ELSE 'gap' END AS status,
    CASE WHEN slot_no = slot THEN n ELSE 0 END AS n_readings, CASE WHEN slot_no = slot THEN mean END AS slot_mean, value FROM valued
"""


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_flags(spark, sf_dir).select("rec_id", "seg_id", "channel", "idx").distinct()


def p4_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implausible readings of all three channels with the kind of each flag."""
    segment, recording = load(spark, sf_dir, "segment"), load(spark, sf_dir, "recording")
    parts = (
        (segment, F.col("seg_id"), "ecg", "ecg", F.col("ecg_rate"), 1.5),
        (segment, F.col("seg_id"), "po", "po", F.col("ppg_rate"), 0.7),
        (recording, F.lit(-1), "ppg", "ppg", F.coalesce("ppg_rate", "ecg_rate"), 0.7),
    )
    channels = None
    for table, seg_id, channel, samples, rate, factor in parts:
        own = table.where(F.size(samples) > 1).select("rec_id", seg_id.alias("seg_id"), F.lit(channel).alias("channel"), F.col(samples).alias("samples"), rate.alias("rate"), F.lit(factor).alias("factor"))
        channels = own if channels is None else channels.union(own)
    return flag_implausible(channels, ["rec_id", "seg_id", "channel"], "samples", "rate", "factor")


def _run_test(n: int) -> str:
    """A run of n readings from here on lies on one side of its neighbours by at least the excess."""
    run = ", ".join(["x", *(f"lead(x, {k}) OVER w" for k in range(1, n))])
    run = run if n == 1 else f"{{side}}({run})"
    low, high = (run.replace("{side}", side) for side in ("least", "greatest"))
    a, b = "lag(x) OVER w", f"lead(x, {n}) OVER w"
    return f"coalesce({a} IS NOT NULL AND {b} IS NOT NULL AND ({low} - greatest({a}, {b}) >= f * h OR least({a}, {b}) - {high} >= f * h), false) AS s{n}"


P4_FOUND = f"""
WITH c AS (SELECT DISTINCT rec_id, seg_id, 'ecg' AS channel, ecg_rate AS fs, 1.5 AS f, ecg AS y FROM segment WHERE len(ecg) > 1
  UNION ALL SELECT DISTINCT rec_id, seg_id, 'po', ppg_rate, 0.7, po FROM segment WHERE len(po) > 1
  UNION ALL SELECT rec_id, -1, 'ppg', coalesce(ppg_rate, ecg_rate), 0.7, ppg FROM recording WHERE len(ppg) > 1),
r AS (SELECT rec_id, seg_id, channel, fs, f::DOUBLE AS f, i - 1 AS idx, y[i] AS x FROM (SELECT *, unnest(range(1, len(y) + 1)) AS i FROM c)),
t AS (SELECT * FROM r WHERE x IS NOT NULL AND NOT isnan(x)),
bad AS (SELECT rec_id, seg_id, channel, idx FROM t WHERE abs(x) > 1000),
j AS (SELECT *, CASE WHEN x = lag(x) OVER w AND idx = lag(idx) OVER w + 1 THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY rec_id, seg_id, channel ORDER BY idx)),
k AS (SELECT *, sum(new) OVER (PARTITION BY rec_id, seg_id, channel ORDER BY idx) AS run FROM j),
held AS (SELECT rec_id, seg_id, channel, idx FROM (SELECT *, count(*) OVER (PARTITION BY rec_id, seg_id, channel, run) AS n FROM k) WHERE n >= 2 AND n >= ceil(0.2 * fs - 1e-9)),
ok AS (SELECT * FROM t WHERE abs(x) <= 1000),
tall AS (SELECT rec_id, seg_id, channel, idx // round(1.6 * fs)::INT AS win, max(x) - min(x) AS height FROM ok GROUP BY ALL HAVING count(*) > 0.8 * any_value(fs)),
usual AS (SELECT rec_id, seg_id, channel, median(height) AS h FROM tall GROUP BY ALL),
s AS (SELECT rec_id, seg_id, channel, idx, {_run_test(1)}, {_run_test(2)}, {_run_test(3)} FROM ok JOIN usual USING (rec_id, seg_id, channel) WINDOW w AS (PARTITION BY rec_id, seg_id, channel ORDER BY idx)),
spikes AS (SELECT rec_id, seg_id, channel, idx FROM (SELECT *, s1 OR s2 OR s3 OR coalesce(lag(s2) OVER w, false) OR coalesce(lag(s3) OVER w, false) OR coalesce(lag(s3, 2) OVER w, false) AS spike
  FROM s WINDOW w AS (PARTITION BY rec_id, seg_id, channel ORDER BY idx)) WHERE spike)
SELECT * FROM bad UNION SELECT * FROM held UNION SELECT * FROM spikes
"""


def _markings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markings of known types as (rec_id, marking_type, start_sample, end_sample)."""
    codes = load(spark, sf_dir, "marking_code").select(F.col("type_id").cast("double").alias("type_id"), "marking_type")
    extra = codes.sparkSession.createDataFrame([(None, "Conduction Delay")], "type_id double, marking_type string")
    known = codes.unionByName(extra)
    plain = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    spelled = known.select(plain("marking_type").alias("as_written"), F.col("marking_type").alias("name")).union(
        known.where("type_id is not null").select(F.col("type_id").cast("string"), "marking_type")
    )
    rates = load(spark, sf_dir, "recording").select("rec_id", "ecg_rate")
    text = plain("marking_type")
    written = F.coalesce(text.try_cast("double").cast("string"), text).alias("as_written")
    noise = load(spark, sf_dir, "noise").select("rec_id", "start_sample", "end_sample", "start_sec", "end_sec", written)
    joined = noise.join(broadcast_if_small(rates), "rec_id").join(broadcast_if_small(spelled), "as_written")
    bound = lambda side: F.coalesce(f"{side}_sample", F.round(F.col(f"{side}_sec") * F.col("ecg_rate")).cast("bigint"))
    return joined.select("rec_id", F.col("name").alias("marking_type"), bound("start").alias("start_sample"), bound("end").alias("end_sample"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge_intervals(_markings(spark, sf_dir), ["rec_id", "marking_type"], "start_sample", "end_sample")
    return merged.withColumnsRenamed({"start": "start_sample", "end": "end_sample"})


P6_FOUND = """
WITH names AS (SELECT type_id, marking_type AS name FROM marking_code UNION ALL SELECT NULL, 'Conduction Delay'),
m AS (SELECT n.rec_id, c.name AS marking_type, coalesce(start_sample, round(start_sec * ecg_rate)::BIGINT) AS a,
    coalesce(end_sample, round(end_sec * ecg_rate)::BIGINT) AS b FROM noise n JOIN recording r USING (rec_id)
    JOIN names c ON lower(replace(n.marking_type, ' ', '')) = lower(replace(c.name, ' ', '')) OR try_cast(trim(n.marking_type) AS DOUBLE) = c.type_id),
i AS (SELECT rec_id, marking_type, least(a, b) AS s, greatest(a, b) AS e FROM m WHERE a IS NOT NULL AND b IS NOT NULL),
o AS (SELECT *, max(e) OVER (PARTITION BY rec_id, marking_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM i),
g AS (SELECT *, sum(CASE WHEN s <= upto + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id, marking_type ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o),
p AS (SELECT rec_id, marking_type, min(s) AS s, max(e) AS e FROM g GROUP BY rec_id, marking_type, island),
q AS (SELECT *, lead(s) OVER (PARTITION BY rec_id, marking_type ORDER BY s) AS next_s FROM p)
SELECT rec_id, marking_type, 'period' AS kind, s AS start_sample, e AS end_sample FROM q
UNION ALL SELECT rec_id, marking_type, 'gap', e + 1, next_s - 1 FROM q WHERE next_s IS NOT NULL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_series, p4_found, p4_flags, p6_found)}


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND, "p2_series": P2_SERIES, "p4_found": P4_FOUND, "p6_found": P6_FOUND}
