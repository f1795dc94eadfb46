"""Session, naming and size-check helpers shared by all operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(stem: str, *taken: Iterable[str]) -> str:
    """A column name built on ``stem`` that clashes with none of ``taken`` (compared without case)."""
    used = {name.lower() for names in taken for name in names}
    name, n = f"__{stem}", 0
    while name.lower() in used:
        n += 1
        name = f"__{stem}{n}"
    return name


def quoted(name: str) -> Column:
    """The column called exactly ``name``, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint.

    The folder is the one the session names in spark.checkpoint.dir; only where none is set and the master is local, as
    in tests, a temporary one is used.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or temporary_folder(spark, "pulseloom-"))
    return df.checkpoint(eager=True)


def temporary_folder(spark: SparkSession, prefix: str) -> str:
    """A folder on this machine; on a cluster, where tasks can't share it, an error."""
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=prefix)


def broadcast_if_small(df: DataFrame, max_bytes: int = 32 << 20) -> DataFrame:
    """A broadcast hint if the rows of ``df`` measure at most ``max_bytes``, else ``df`` as it is.

    The size is measured by an aggregate over ``df`` (strings by their length, arrays and maps by 48 bytes an element,
    structs by 64 bytes, other columns by 8, plus 16 a row), so the hint never depends on an estimate. Beyond the bound
    the join shuffles.
    """
    width: Column = F.lit(16)
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            part = F.coalesce(F.octet_length(quoted(name)), F.lit(0))
        elif kind.startswith(("array", "map")):
            part = F.greatest(F.coalesce(F.size(quoted(name)), F.lit(0)), F.lit(0)) * 48
        else:
            part = F.lit(64 if kind.startswith("struct") else 8)
        width = width + part
    size = df.select(F.sum(width).alias("size")).first()["size"] or 0
    return F.broadcast(df) if size <= max_bytes else df


def join_summary(df: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the other columns of ``summary``, which has at most one row a key; equal null keys meet.

    Rows of ``df`` don't move while the summary is small enough to be broadcast, however many of them one key has. The
    summary is written once, so that measuring it doesn't compute it again.
    """
    names = [fresh(f"key{i}", df.columns, summary.columns) for i in range(len(keys))]
    side = broadcast_if_small(cut(summary).withColumnsRenamed(dict(zip(keys, names, strict=True))))
    same = F.lit(True)
    for key, name in zip(keys, names, strict=True):
        same = same & quoted(key).eqNullSafe(F.col(name))
    return df.join(side, same, "left").drop(*names)


def is_number(column: Column) -> Column:
    """True where a floating-point column is neither null nor NaN."""
    return column.isNotNull() & ~F.isnan(column)


def latest(df: DataFrame, keys: list[str], by: str, *, partition: list[str] | None = None) -> DataFrame:
    """Of several rows with the same ``keys``, the one with the largest ``by``.

    Equal ``by``: the row that is largest when its other columns are compared in name order; nulls come last. Null
    keys form a group of their own. With ``partition`` (columns that the keys determine) the rows are laid out by
    those columns first, and later steps on them need no further shuffle.
    """
    rest = sorted(c for c in df.columns if c not in keys and c != by)
    if partition:
        df = df.repartition(*map(quoted, partition))
    row = fresh("row", df.columns)
    best = df.groupBy(*map(quoted, keys)).agg(F.max(F.struct(quoted(by), *map(quoted, rest))).alias(row))
    return best.select(*map(quoted, keys), quoted(row)[by].alias(by), *(quoted(row)[c].alias(c) for c in rest))
