"""Event-time windows over streams: tumbling statistics and gap sessions, written by upserts that can be repeated."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseloom.functions.common import temporary_folder


def tumbling_statistics(events: DataFrame, keys: list[str], time: str, value: str, width: str, delay: str) -> DataFrame:
    """Count, sum and extremes by key and tumbling window; rows later than ``delay`` behind the newest are dropped."""
    return (
        events.withWatermark(time, delay)
        .groupBy(F.window(time, width).alias("w"), *keys)
        .agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("largest"))
        .select(*keys, F.col("w.start").alias("window_start"), "n", "total", "least", "largest")
    )


def gap_sessions(events: DataFrame, keys: list[str], time: str, gap: str, delay: str) -> DataFrame:
    """Sessions of events by key that are less than ``gap`` apart."""
    return (
        events.withWatermark(time, delay)
        .groupBy(F.session_window(time, gap).alias("w"), *keys)
        .agg(F.count("*").alias("n"))
        .select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that the session names; a temporary one where it names none and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return f"{base}/{name}-{uuid.uuid4().hex}" if base else temporary_folder(spark, f"pulseloom-{name}-")


def run_to_table(stream: DataFrame, path: str, ids: list[str], *, mode: str = "update") -> DataFrame:
    """Run a stream over all that is there now and return its latest row for each of ``ids``.

    Each batch writes its changes into a folder of its own, so a batch that is repeated after a failure replaces what
    it wrote before.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/data/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in ids]
    # a stream without any row writes nothing: the schema is given, and files are found by pattern
    kept = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("__batch", T.IntegerType())])).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path)
    return kept.groupBy(*ids).agg(F.max(F.struct("__batch", *rest)).alias("row")).select(*ids, *(F.col("row")[c].alias(c) for c in rest))
