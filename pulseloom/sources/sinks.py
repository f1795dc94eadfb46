"""Writers: long-form feature files, appended window tables, status and error tables, and skipping of finished work."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.functions.common import quoted
from pulseloom.operators.windows import unpivot


def write_feature_files(df: DataFrame, path: str, ids: list[str], features: list[str], *, rename: dict[str, str] | None = None, buckets: int = 256) -> None:
    """One folder for each feature and bucket of recordings, with the feature's values in order of the ids.

    Recordings share ``buckets`` folders by a hash, so their number doesn't set the number of files; rows are sorted by
    recording, so a reader that asks for one skips the rest by the files' statistics.
    """
    long = unpivot(df, ids, features)
    if rename:
        names = F.create_map(*(F.lit(x) for pair in rename.items() for x in pair))
        long = long.withColumn("feature", F.coalesce(F.try_element_at(names, F.col("feature")), F.col("feature")))
    long = long.withColumn("bucket", F.pmod(F.xxhash64("rec_id"), F.lit(buckets)))
    laid = long.repartition("feature", "bucket").sortWithinPartitions("feature", "bucket", *map(quoted, ids))
    laid.write.partitionBy("feature", "bucket").mode("overwrite").parquet(path)


def append_windows(df: DataFrame, path: str, *, digits: int = 15) -> None:
    """Append rows to a CSV table with a header in each file and doubles of ``digits`` significant digits."""
    text = [F.format_string(f"%.{digits}g", c).alias(c) if kind == "double" else quoted(c) for c, kind in df.dtypes]
    df.select(*text).write.mode("append").csv(path, header=True)


def existing(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A Parquet table, or an empty one like ``like`` where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":  # an unreadable table is not a missing one
            raise
        return spark.createDataFrame([], like.schema)


def not_done(work: DataFrame, path: str, on: list[str]) -> DataFrame:
    """The rows of ``work`` whose ids are not in the table at ``path`` yet."""
    done = existing(work.sparkSession, path, work.select(*map(quoted, on)))
    return work.join(done.select(*map(quoted, on)).distinct(), on, "left_anti")


def update_status(spark: SparkSession, path: str, changes: DataFrame, on: list[str]) -> None:
    """Write a status table with ``changes`` in place of the rows of the same ids; the old version is read fully first."""
    from pulseloom.functions.common import cut

    old = existing(spark, path, changes)
    new = cut(old.join(changes.select(*map(quoted, on)), on, "left_anti").unionByName(changes))
    new.write.mode("overwrite").parquet(path)


def split_errors(df: DataFrame, error: str, path: str) -> DataFrame:
    """Append the rows with an error message to a side table and return the others without that column."""
    df.where(quoted(error).isNotNull()).write.mode("append").parquet(path)
    return df.where(quoted(error).isNull()).drop(error)
