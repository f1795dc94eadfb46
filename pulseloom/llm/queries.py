"""Registered queries of the training-data operators and, where SQL can state them, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.functions.common import broadcast_if_small, is_number, latest, load
from pulseloom.llm import percentiles as sketch
from pulseloom.llm.collapse_runs import collapse_runs
from pulseloom.llm.language import find_languages
from pulseloom.llm.leakage import find_leaks
from pulseloom.llm.nearest_time import match_nearest_time
from pulseloom.llm.packing import count_tokens, pack_items

PERCENTILES = [0.05, 0.25, 0.5, 0.75, 0.95]
PAIR_TOLERANCE = 0.401


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = load(spark, sf_dir, "recording").select("rec_id", "ecg_rate", F.coalesce("ppg_rate", "ecg_rate").alias("ppg_rate"))
    return broadcast_if_small(own)


def _beats(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rates = _rates(spark, sf_dir)
    peaks = load(spark, sf_dir, "r_peak").where("idx >= 0").join(rates, "rec_id")
    valleys = load(spark, sf_dir, "ppg_valley").where("idx >= 0").join(rates, "rec_id")
    return (
        peaks.select("rec_id", "seg_id", F.col("idx").alias("r_idx"), (F.col("idx") / F.col("ecg_rate")).alias("r_sec")),
        valleys.select("rec_id", "seg_id", F.col("idx").alias("ppg_idx"), (F.col("idx") / F.col("ppg_rate")).alias("ppg_sec")),
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks, valleys = _beats(spark, sf_dir)
    matched = match_nearest_time(
        peaks, valleys, ["rec_id", "seg_id"], "r_sec", "ppg_sec", PAIR_TOLERANCE, {"ppg_idx": "ppg_idx"}, how="inner", distinct=True
    )
    return matched.select("rec_id", "seg_id", "r_idx", "ppg_idx")


P1_FOUND = """
WITH rates AS (SELECT rec_id, ecg_rate, coalesce(ppg_rate, ecg_rate) AS ppg_rate FROM recording),
p AS (SELECT DISTINCT rec_id, seg_id, idx, idx / ecg_rate AS t FROM r_peak JOIN rates USING (rec_id) WHERE idx >= 0),
v AS (SELECT DISTINCT rec_id, seg_id, idx, idx / ppg_rate AS t FROM ppg_valley JOIN rates USING (rec_id) WHERE idx >= 0),
near AS (SELECT p.rec_id, p.seg_id, p.idx AS r_idx, v.idx AS ppg_idx,
    row_number() OVER (PARTITION BY p.rec_id, p.seg_id, p.idx ORDER BY abs(p.t - v.t), v.t) AS place
  FROM p JOIN v ON p.rec_id = v.rec_id AND p.seg_id = v.seg_id AND abs(p.t - v.t) <= 0.401)
SELECT rec_id, seg_id, r_idx, ppg_idx FROM near WHERE place = 1
"""


def _stage_code(column: str) -> F.Column:
    """0..5 where the value is within 0.001 of it, else -1 (unknown)."""
    value = F.col(column).cast("double")
    near = is_number(value) & (F.abs(value - F.round(value)) <= 0.001) & F.round(value).between(0, 5)
    return F.when(near, F.round(value).cast("int")).otherwise(F.lit(-1))


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    epochs = load(spark, sf_dir, "sleep_epoch").select(
        "rec_id", F.lit(-1).alias("seg_id"), F.col("epoch_no").alias("epoch"), _stage_code("stage").alias("code"), "loaded_at"
    )
    arrays = load(spark, sf_dir, "segment").select("rec_id", "seg_id", F.posexplode("sleep_stages").alias("epoch", "stage"))
    own = arrays.select("rec_id", "seg_id", "epoch", _stage_code("stage").alias("code"), F.lit(None).cast("timestamp_ntz").alias("loaded_at"))
    return epochs.union(own)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = collapse_runs(_stages(spark, sf_dir), ["rec_id", "seg_id"], "epoch", "code", latest_by="loaded_at")
    return runs.where("n_events >= 2").select("rec_id", "seg_id", F.col("start").cast("int").alias("start_epoch"), F.col("n_events").cast("int").alias("n_epochs"))


P3_STAGES = """
WITH ep AS (SELECT rec_id, -1 AS seg_id, epoch_no AS epoch, stage::DOUBLE AS v
    FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, epoch_no ORDER BY loaded_at DESC) AS place FROM sleep_epoch)
    WHERE place = 1 AND epoch_no IS NOT NULL),
sg AS (SELECT DISTINCT rec_id, seg_id, i - 1 AS epoch, sleep_stages[i] AS v
    FROM (SELECT *, unnest(range(1, len(sleep_stages) + 1)) AS i FROM segment WHERE len(sleep_stages) > 0)),
codes AS (SELECT rec_id, seg_id, epoch, CASE WHEN v IS NULL OR isnan(v) OR NOT abs(v - round(v)) <= 0.001
    OR round(v) NOT BETWEEN 0 AND 5 THEN -1 ELSE round(v)::INT END AS code FROM (SELECT * FROM ep UNION ALL SELECT * FROM sg)),
runs AS (SELECT *, epoch - row_number() OVER (PARTITION BY rec_id, seg_id, code ORDER BY epoch) AS island FROM codes)
"""
P3_FOUND = P3_STAGES + """
SELECT rec_id, seg_id, min(epoch)::INT AS start_epoch, count(*)::INT AS n_epochs
FROM runs GROUP BY rec_id, seg_id, code, island HAVING count(*) >= 2
"""


def p3_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs with their code and their duration in seconds, from the times at which their epochs begin and end."""
    length = broadcast_if_small(load(spark, sf_dir, "recording").select("rec_id", "epoch_sec"))
    timed = _stages(spark, sf_dir).join(length, "rec_id")
    timed = timed.withColumns({"begins": F.col("epoch") * F.col("epoch_sec"), "ends": (F.col("epoch") + 1) * F.col("epoch_sec")})
    runs = collapse_runs(timed, ["rec_id", "seg_id"], "epoch", "code", from_time="begins", to_time="ends", latest_by="loaded_at")
    return runs.select(
        "rec_id", "seg_id", "code", F.col("start").cast("int").alias("start_epoch"), F.col("n_events").cast("int").alias("n_epochs"), F.col("duration").alias("duration_sec")
    )


P3_RUNS = P3_STAGES + """
SELECT rec_id, seg_id, code, min(epoch)::INT AS start_epoch, count(*)::INT AS n_epochs, count(*) * any_value(epoch_sec) AS duration_sec
FROM runs JOIN recording USING (rec_id) GROUP BY rec_id, seg_id, code, island
"""


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid beat intervals, of each beat the latest row; rows of a segment stay together."""
    stage = F.nanvl("sleep_stages", F.lit(None).cast("double")).alias("sleep_stages")
    part = F.floor(F.col("beat_no") / 65536).alias("part")
    rows = load(spark, sf_dir, "beat_feature").select("rec_id", "seg_id", part, "beat_no", stage, "sec_valley_2_valley", "loaded_at")
    held = latest(rows, ["rec_id", "seg_id", "part", "beat_no"], "loaded_at", partition=["rec_id", "seg_id", "part"])
    return held.where(is_number(F.col("sec_valley_2_valley")) & (F.col("sec_valley_2_valley") >= 0))


GROUPINGS = {"recording": ["rec_id"], "stage": ["sleep_stages"], "all": []}


def _interval_percentiles(values: DataFrame, size: int = sketch.SIZE, fan: int = sketch.FAN) -> DataFrame:
    """By recording, by stage and over all, sketched in one pass."""
    rolled = sketch.build_rollups(values, GROUPINGS, "sec_valley_2_valley", size=size, fan=fan)
    return sketch.percentiles(rolled, ["kind", "rec_id", "sleep_stages"], PERCENTILES, size=size, fan=fan)


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the beat interval with the rank error that is proven for each."""
    return _interval_percentiles(_intervals(spark, sf_dir))


#: The exact percentiles. Groups of up to size x fan values (32,768) are never collapsed, so up to there both agree.
P5_PERCENTILES = """
WITH v AS (SELECT rec_id, CASE WHEN NOT isnan(sleep_stages) THEN sleep_stages END AS sleep_stages, sec_valley_2_valley AS v FROM (SELECT *, row_number() OVER
      (PARTITION BY rec_id, seg_id, beat_no ORDER BY loaded_at DESC) AS place FROM beat_feature)
    WHERE place = 1 AND sec_valley_2_valley IS NOT NULL AND NOT isnan(sec_valley_2_valley) AND sec_valley_2_valley >= 0),
g AS (SELECT 'recording' AS kind, rec_id, NULL::DOUBLE AS sleep_stages, count(*) AS n, list_sort(list(v)) AS l FROM v GROUP BY rec_id
  UNION ALL SELECT 'stage', NULL, sleep_stages, count(*), list_sort(list(v)) FROM v GROUP BY sleep_stages
  UNION ALL SELECT 'all', NULL, NULL, count(*), list_sort(list(v)) FROM v)
SELECT kind, rec_id, sleep_stages, p::DOUBLE AS p, n, l[greatest(1, ceil(p::DOUBLE * n))::INT] AS value, 0::BIGINT AS rank_error
FROM g, (VALUES (0.05), (0.25), (0.5), (0.75), (0.95)) AS q(p) WHERE n > 0
"""


def _bound_check(spark: SparkSession, sf_dir: str, size: int, fan: int) -> DataFrame:
    """For each percentile of the interval: its group's exact size, and whether its exact rank keeps the stated bound.

    The bound itself must be no larger than the theory's ``(levels + 2) / (2 * size)`` of n, and above 0 where buffers
    must have been collapsed.
    """
    values = _intervals(spark, sf_dir)
    asked = _interval_percentiles(values, size, fan)
    by_group = asked.groupBy("kind", "rec_id", "sleep_stages").agg(F.collect_list(F.struct("p", "n", "value", "rank_error")).alias("asked"))
    kinds = F.array(
        F.struct(F.lit("recording").alias("kind"), F.col("rec_id"), F.lit(None).cast("double").alias("sleep_stages")),
        F.struct(F.lit("stage").alias("kind"), F.lit(None).cast("string").alias("rec_id"), F.col("sleep_stages")),
        F.struct(F.lit("all").alias("kind"), F.lit(None).cast("string").alias("rec_id"), F.lit(None).cast("double").alias("sleep_stages")),
    )
    counted = values.groupBy("rec_id", "sleep_stages", F.col("sec_valley_2_valley").alias("v")).count()
    wide = counted.select(F.explode(kinds).alias("g"), "v", "count").groupBy("g.kind", "g.rec_id", "g.sleep_stages", "v").agg(F.sum("count").alias("count"))
    same = (wide["kind"] == by_group["kind"]) & wide["rec_id"].eqNullSafe(by_group["rec_id"]) & wide["sleep_stages"].eqNullSafe(by_group["sleep_stages"])
    each = wide.join(broadcast_if_small(by_group), same).select(by_group["kind"], by_group["rec_id"], by_group["sleep_stages"], "v", "count", F.explode("asked").alias("a"))
    ranks = each.groupBy("kind", "rec_id", "sleep_stages", F.col("a.p").alias("p"), F.col("a.rank_error").alias("e"), F.col("a.n").alias("said")).agg(
        F.sum("count").alias("n"), F.sum(F.when(F.col("v") < F.col("a.value"), F.col("count")).otherwise(0)).alias("below"), F.sum(F.when(F.col("v") <= F.col("a.value"), F.col("count")).otherwise(0)).alias("upto")
    )
    wanted, levels = F.col("p") * F.col("n"), F.greatest(F.ceil(F.log(F.col("n") / size) / F.log(F.lit(float(fan)))), F.lit(0))
    sharp = (F.col("e") <= F.col("n") * (levels + 2) / (2 * size)) & ((F.col("e") > 0) | (F.col("n") < (fan + 1) * size))
    kept = (F.col("below") - 1 <= wanted + F.col("e")) & (F.col("upto") + 1 >= wanted - F.col("e")) & (F.col("said") == F.col("n")) & sharp
    return ranks.select("kind", "rec_id", "sleep_stages", "p", "n", kept.alias("within_bound"))


def p5_bound_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated bounds of :func:`p5_percentiles` against exact ranks."""
    return _bound_check(spark, sf_dir, sketch.SIZE, sketch.FAN)


def p5_bound_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with buffers of 64 values and fan 4, which are collapsed over several levels in small groups too."""
    return _bound_check(spark, sf_dir, 64, 4)


P5_BOUND_CHECK = """
WITH v AS (SELECT rec_id, CASE WHEN NOT isnan(sleep_stages) THEN sleep_stages END AS sleep_stages FROM (SELECT *, row_number() OVER
      (PARTITION BY rec_id, seg_id, beat_no ORDER BY loaded_at DESC) AS place FROM beat_feature)
    WHERE place = 1 AND sec_valley_2_valley IS NOT NULL AND NOT isnan(sec_valley_2_valley) AND sec_valley_2_valley >= 0),
g AS (SELECT 'recording' AS kind, rec_id, NULL::DOUBLE AS sleep_stages, count(*) AS n FROM v GROUP BY rec_id
  UNION ALL SELECT 'stage', NULL, sleep_stages, count(*) FROM v GROUP BY sleep_stages
  UNION ALL SELECT 'all', NULL, NULL, count(*) FROM v)
SELECT kind, rec_id, sleep_stages, p::DOUBLE AS p, n, true AS within_bound
FROM g, (VALUES (0.05), (0.25), (0.5), (0.75), (0.95)) AS q(p) WHERE n > 0
"""


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in containers of each capacity; every window has the sources in proportion to their tokens."""
    capacities = [row["capacity_tokens"] for row in load(spark, sf_dir, "pack_size").orderBy("pack_id").collect()]  # three rows
    sizes = count_tokens(load(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text")
    return pack_items(sizes, "doc_id", "source", "n_tokens", capacities)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used for each capacity, the least number possible by tokens, and the share of room filled."""
    packed = p7_containers(spark, sf_dir).where("container_no is not null")
    boxes = packed.groupBy("capacity_tokens", "window_no", "container_no").agg(F.sum("n_tokens").alias("tokens"))
    return boxes.groupBy("capacity_tokens").agg(
        F.count("*").alias("containers"),
        F.ceil(F.sum("tokens") / F.col("capacity_tokens")).alias("least"),
        F.max(F.col("tokens") <= F.col("capacity_tokens")).alias("none_overfull"),
        (F.sum("tokens") / (F.count("*") * F.col("capacity_tokens"))).alias("filled"),
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_item"), "doc_id", "text", "item_id", "passage", edited=False)
    return leaks.where("run_words >= 10").select("doc_id", "item_id")


#: SQL has NFC only; texts with compatibility characters inside a leaked stretch (none at sf0.01) need the NFKC of the operator.
P8_FOUND = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(nfc_normalize(passage)), '[\p{L}\p{N}]+') AS w FROM eval_item WHERE passage IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[k:k + 9], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 8)) AS k FROM d WHERE len(w) >= 10)),
ig AS (SELECT item_id, array_to_string(w[k:k + 9], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 8)) AS k FROM i WHERE len(w) >= 10))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that shares five words in a row with an item, with the longest common run and the alignment score."""
    return find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_item"), "doc_id", "text", "item_id", "passage")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p9_languages(spark, sf_dir)
    right = (F.col("n_languages") == 1) & F.col("label").eqNullSafe(F.col("lang"))
    return found.where(~right).select("doc_id", "lang")


def p9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of every message with their shares, confidences and parts, beside what the label says."""
    return find_languages(load(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p3_found, p3_runs, p5_percentiles, p5_bound_check, p5_bound_small, p7_containers, p7_fill, p8_found, p8_leaks, p9_found, p9_languages)}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p3_found": P3_FOUND, "p3_runs": P3_RUNS, "p5_percentiles": P5_PERCENTILES, "p5_bound_check": P5_BOUND_CHECK, "p5_bound_small": P5_BOUND_CHECK, "p8_found": P8_FOUND}
