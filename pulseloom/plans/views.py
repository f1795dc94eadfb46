"""The tables as the operators take them, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.functions.common import broadcast_if_small, is_number, latest, load

SEG = ["rec_id", "seg_id"]


def rounded(column: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; NaN is null and -0 is 0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(F.nanvl(c.cast("double"), F.lit(None).cast("double")), digits) + 0.0


def rates(spark: SparkSession, d: str) -> DataFrame:
    """(rec_id, ecg_rate, ppg_rate, epoch_sec) with complete rates; broadcast while it is small."""
    own = load(spark, d, "recording").select("rec_id", "ecg_rate", F.coalesce("ppg_rate", "ecg_rate").alias("ppg_rate"), "epoch_sec")
    return broadcast_if_small(own)


def channel_arrays(spark: SparkSession, d: str, channel: str = "po") -> DataFrame:
    """One array of each segment's channel (rec_id, seg_id, fs, x); impossible samples are null, absent channels left out.

    Repeated rows are told by the Parquet file and row they stand in, so that no samples are moved to drop them.
    """
    rate = {"po": "ppg_rate", "ecg": "ecg_rate"}[channel]
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = load(spark, d, "segment").select(*SEG, F.col(rate).alias("fs"), F.col(channel).alias("x"), place.alias("place")).where(F.size("x") > 1)
    first = rows.groupBy(*SEG).agg(F.min("place").alias("place")).select("place")
    one = rows.join(broadcast_if_small(first), "place", "left_semi")
    return one.select(*SEG, "fs", F.transform("x", lambda v: F.when(is_number(v) & (F.abs(v) <= 1000), v)).alias("x"))


def signal(spark: SparkSession, d: str, channel: str = "po") -> DataFrame:
    """Samples (rec_id, seg_id, fs, idx, value) of a segment channel; absent channels and impossible samples are left out or null."""
    long = channel_arrays(spark, d, channel).select(*SEG, "fs", F.posexplode("x").alias("idx", "value"))
    return long.select(*SEG, "fs", F.col("idx").cast("bigint").alias("idx"), "value")


def signal_sql(channel: str = "po") -> str:
    rate = {"po": "ppg_rate", "ecg": "ecg_rate"}[channel]
    return (
        f"sig AS (SELECT rec_id, seg_id, fs, i - 1 AS idx, CASE WHEN isnan(x) OR abs(x) > 1000 THEN NULL ELSE x END AS value FROM "
        f"(SELECT rec_id, seg_id, fs, i, y[i] AS x FROM (SELECT *, unnest(range(1, len(y) + 1)) AS i FROM "
        f"(SELECT DISTINCT rec_id, seg_id, {rate} AS fs, {channel} AS y FROM segment WHERE len({channel}) > 1))))"
    )


def beats(spark: SparkSession, d: str) -> DataFrame:
    """Of each beat the latest row, with its begin in seconds (null if unknown); NaN is null."""
    rows = load(spark, d, "beat_feature").withColumn("part", F.floor(F.col("beat_no") / 65536))
    own = latest(rows, [*SEG, "part", "beat_no"], "loaded_at", partition=[*SEG, "part"]).join(rates(spark, d).select("rec_id", "ppg_rate"), "rec_id")
    clean = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c)
    return own.select(
        *SEG, "beat_no", "idx_begin", "idx_systolic", clean("sec_valley_2_valley"), clean("sleep_stages"), clean("area"), "error_ppg_segmentation", "ppg_rate", (F.col("idx_begin") / F.col("ppg_rate")).alias("sec")
    )


BEATS_SQL = (
    "beats AS (SELECT rec_id, seg_id, beat_no, idx_begin, idx_systolic, CASE WHEN NOT isnan(sec_valley_2_valley) THEN sec_valley_2_valley END AS sec_valley_2_valley, "
    "CASE WHEN NOT isnan(sleep_stages) THEN sleep_stages END AS sleep_stages, CASE WHEN NOT isnan(area) THEN area END AS area, error_ppg_segmentation, "
    "coalesce(ppg_rate, ecg_rate) AS ppg_rate, idx_begin / coalesce(ppg_rate, ecg_rate) AS sec FROM (SELECT *, row_number() OVER "
    "(PARTITION BY rec_id, seg_id, beat_no ORDER BY loaded_at DESC) AS place FROM beat_feature) JOIN recording USING (rec_id) WHERE place = 1)"
)


def events_of(spark: SparkSession, d: str, table: str) -> DataFrame:
    """Distinct detections (rec_id, seg_id, idx, sec) of r_peak or ppg_valley."""
    rate = {"r_peak": "ecg_rate", "ppg_valley": "ppg_rate"}[table]
    rows = load(spark, d, table).where("idx >= 0").distinct().join(rates(spark, d), "rec_id")
    return rows.select(*SEG, "idx", (F.col("idx") / F.col(rate)).alias("sec"))


def events_sql(table: str, name: str) -> str:
    rate = {"r_peak": "ecg_rate", "ppg_valley": "coalesce(ppg_rate, ecg_rate)"}[table]
    return f"{name} AS (SELECT DISTINCT rec_id, seg_id, idx, idx / {rate} AS sec FROM {table} JOIN recording USING (rec_id) WHERE idx >= 0)"


def epochs(spark: SparkSession, d: str) -> DataFrame:
    """Of each epoch the latest row: (rec_id, epoch_no, stage)."""
    rows = load(spark, d, "sleep_epoch").where("epoch_no is not null").withColumn("part", F.floor(F.col("epoch_no") / 65536))
    return latest(rows, ["rec_id", "part", "epoch_no"], "loaded_at", partition=["rec_id", "part"]).select("rec_id", "epoch_no", "stage")


EPOCHS_SQL = "ep AS (SELECT rec_id, epoch_no, stage FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, epoch_no ORDER BY loaded_at DESC) AS place FROM sleep_epoch) WHERE place = 1 AND epoch_no IS NOT NULL)"


def markings(spark: SparkSession, d: str) -> DataFrame:
    """Distinct markings with both bounds in whole milliseconds: (rec_id, label, s, e), s <= e; labels in capitals."""
    ms = lambda c: F.round(c * 1000).cast("bigint")
    rows = load(spark, d, "noise").where("start_sec is not null and end_sec is not null")
    return rows.select("rec_id", F.upper("label").alias("label"), ms(F.least("start_sec", "end_sec")).alias("s"), ms(F.greatest("start_sec", "end_sec")).alias("e")).distinct()


MARKINGS_SQL = (
    "nz AS (SELECT DISTINCT rec_id, upper(label) AS label, round(least(start_sec, end_sec) * 1000)::BIGINT AS s, round(greatest(start_sec, end_sec) * 1000)::BIGINT AS e "
    "FROM noise WHERE start_sec IS NOT NULL AND end_sec IS NOT NULL)"
)
MERGED_SQL = MARKINGS_SQL + (
    ", mo AS (SELECT *, max(e) OVER (PARTITION BY rec_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM nz), "
    "mg AS (SELECT *, sum(CASE WHEN s <= upto THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM mo), "
    "merged AS (SELECT rec_id, min(s) AS s, max(e) AS e FROM mg GROUP BY rec_id, island)"
)


def waves(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings as waves in long form: (label, vec_id, pos, value)."""
    long = load(spark, d, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("pos", "value"))
    return long.select("label", "vec_id", "pos", F.col("value").cast("double").alias("value"))


WAVES_SQL = "wv AS (SELECT label, vec_id, i - 1 AS pos, embedding[i]::DOUBLE AS value FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"
