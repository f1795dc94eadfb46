"""Automatic noise intervals of sampled channels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulseloom.functions import kernels
from pulseloom.functions.common import quoted
from pulseloom.operators.interval_islands import PERIOD, merge_intervals
from pulseloom.operators.moving import ampogram, moving_std
from pulseloom.operators.runs import cluster_by_gap


def unusual_windows(heights: DataFrame, keys: list[str], order: str, value: str, *, most: float = 0.1, alpha: float = 0.05) -> DataFrame:
    """Rows whose value is an outlier of its entity by the generalised extreme studentised deviate test.

    ``heights`` has one row per window, far fewer than samples; at most the share ``most`` of an entity's windows is
    tested. Null values are no outliers.
    """
    schema = T.StructType([*heights.select(*map(quoted, keys), quoted(order)).schema.fields])
    arrow = to_arrow_schema(schema)

    def test(table: pa.Table) -> pa.Table:
        values = np.array([np.nan if v is None else v for v in table[value].to_pylist()], float)
        mask = kernels.extreme_deviates(values, max(1, int(most * len(values))), alpha)
        return table.filter(pa.array(mask)).select(arrow.names).cast(arrow)

    return heights.select(*map(quoted, keys), quoted(order), quoted(value)).groupBy(*map(quoted, keys)).applyInArrow(test, schema)


def automatic_noise(signal: DataFrame, keys: list[str], position: str, value: str, *, window: int, flat: int, join: int, widen: int) -> DataFrame:
    """Noise intervals (keys, low, high) in positions: windows of unusual height, and flat stretches.

    Heights are taken over ``window`` positions; a sample is flat where the deviation over ``flat`` positions is 0.
    Marked positions at most ``join`` apart are joined, the intervals widened by ``widen`` (not below 0) and merged.
    """
    heights = ampogram(signal, keys, position, value, window)
    spikes = unusual_windows(heights, keys, "window_no", "height")
    spikes = spikes.select(*map(quoted, keys), (F.col("window_no") * window).alias("low"), ((F.col("window_no") + 1) * window - 1).alias("high"))
    still = moving_std(signal, keys, position, value, flat).where("moving_std = 0")
    stretches = cluster_by_gap(still, keys, position, join).select(*map(quoted, keys), F.col("first").alias("low"), F.col("last").alias("high"))
    wide = spikes.unionByName(stretches).withColumns({"low": F.greatest(F.col("low") - widen, F.lit(0)), "high": F.col("high") + widen})
    merged = merge_intervals(wide, keys, "low", "high").where(F.col("kind") == PERIOD)
    return merged.select(*map(quoted, keys), F.col("start").alias("low"), F.col("end").alias("high"))
