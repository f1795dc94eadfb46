"""The three stages, each on its own: clean segments, beats and pairs, beat features.

Each stage takes and returns DataFrames. Stages B and C read the segments' excerpts, not what the stage before returns; window
statistics are queries of their own. :func:`run_stage` keeps a stage's result as Parquet and computes only recordings that are
not there yet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.functions.common import cut, load
from pulseloom.operators import beats as E
from pulseloom.operators import channels as C
from pulseloom.operators import intervals as I
from pulseloom.operators import matching as M
from pulseloom.operators.interval_islands import PERIOD, merge_intervals
from pulseloom.plans.views import SEG, channel_arrays, markings, rounded
from pulseloom.sources.sinks import existing, not_done


def clean_segments(noise: DataFrame, lengths: DataFrame, *, target_ms: int = 900_000, least_noise_ms: int = 5_000) -> DataFrame:
    """Stage A: pieces (rec_id, final_bin, s, e) of about ``target_ms`` without noise, in milliseconds.

    ``noise`` has (rec_id, s, e) and ``lengths`` (rec_id, length_ms). Noise shorter than ``least_noise_ms`` is ignored;
    pieces shorter than half a target move to their neighbour. Two of them that share a bin border are joined first, and stay
    as a bin of their own if they are half a target together. As in the original, short pieces in the outer halves of the first
    and last bin, and movers without a staying piece on their side, belong to no bin.
    """
    merged = merge_intervals(noise.where(F.col("e") - F.col("s") >= least_noise_ms), ["rec_id"], "s", "e", touch=0)
    long_noise = merged.where(F.col("kind") == PERIOD).select("rec_id", F.col("start").alias("s"), F.col("end").alias("e"))
    bounds = lengths.select("rec_id", F.lit(0).cast("bigint").alias("low"), F.col("length_ms").alias("high"))
    free = I.complement(long_noise, bounds, ["rec_id"], "s", "e", "low", "high")
    pieces = I.split_at_bins(free, "s", "e", target_ms)
    last = pieces.groupBy("rec_id").agg(F.max("bin_no").alias("last_bin"))
    placed = pieces.join(last, "rec_id").withColumns({"low": F.col("bin_no") * target_ms, "high": (F.col("bin_no") + 1) * target_ms})
    marked = I.mark_for_moving(placed, "s", "e", "low", "high", F.col("bin_no") == 0, F.col("bin_no") == F.col("last_bin"), target_ms / 2)
    merged = I.merge_moving(marked, ["rec_id"], "s", "e", target_ms / 2, join_short=True)
    return I.assign_moved(merged, ["rec_id"], "s").where("final_bin is not null").select("rec_id", "final_bin", "s", "e")


def pulse_points(channels: DataFrame, keys: list[str]) -> DataFrame:
    """Valleys and peaks (keys, kind, idx, value) of pulse waves (keys, fs, x), with frames of a quarter and one second at each rate."""
    wide = lambda c: F.greatest(F.bround(c).cast("int"), F.lit(2))
    own = channels.withColumns({"soft": wide(F.col("fs") / 4), "wide": wide(F.col("fs"))})
    return C.pulse_valleys_and_peaks(own, keys, "x", smooth_width="soft", mean_width="wide")


def beats_and_pairs(segments: DataFrame, channels: DataFrame) -> DataFrame:
    """Stage B: R peaks of the ECG arrays in ``segments``, by the vote of the detectors, with the pulse valley each is paired with, in seconds.

    ``channels`` are the pulse waves (rec_id, seg_id, fs, x). Segments whose peaks are fewer than half or more than one and
    a half times their valleys keep their valleys unpaired.
    """
    peaks = E.voted_beats(segments, [*SEG, "ecg_rate"], "ecg", "ecg_rate").select(*SEG, (F.col("idx") / F.col("ecg_rate")).alias("r_sec")).distinct()
    peaks = cut(peaks)
    valleys = pulse_points(channels, SEG).where("kind = 'valley'").join(channels.select(*SEG, "fs"), SEG).select(*SEG, (F.col("idx") / F.col("fs")).alias("ppg_sec"))
    valleys = cut(valleys)
    peaks = M.plausible_peaks(peaks, valleys, SEG)
    pairs = M.add_unmatched(M.match_between_neighbours(peaks, valleys, SEG, "r_sec", "ppg_sec"), valleys, SEG, "r_sec", "ppg_sec")
    samples = channels.select(*SEG, "fs", F.posexplode("x").alias("idx", "value")).withColumn("sec", F.col("idx") / F.col("fs"))
    return M.settle_all(pairs, samples, SEG, "r_sec", "ppg_sec", "sec", "value")


def beat_features(channels: DataFrame) -> DataFrame:
    """Stage C: measures of all beats between the valleys of pulse waves (rec_id, seg_id, fs, x)."""
    bounds = C.beat_bounds(pulse_points(channels, SEG).where("kind = 'valley'"), SEG)
    return C.beat_measures(channels, cut(bounds), SEG, "x", carry=("fs",))


def run_stage(spark: SparkSession, path: str, work: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply ``stage`` to the recordings of ``work`` that ``path`` doesn't hold yet, append the result, and return the whole.

    The files of a run are as many as its partitions, not its recordings.
    """
    todo = not_done(work, path, ["rec_id"])
    if not todo.isEmpty():
        stage(todo).write.mode("append").parquet(path)
    return existing(spark, path, work)


def pipeline_segments(spark: SparkSession, d: str) -> DataFrame:
    """Stage A over all recordings, as long as their last marking or segment."""
    noise = markings(spark, d).select("rec_id", "s", "e")
    ends = load(spark, d, "segment").select("rec_id", F.round(F.col("ecg_end") / F.col("ecg_rate") * 1000).cast("bigint").alias("e"))
    lengths = noise.select("rec_id", "e").unionByName(ends).groupBy("rec_id").agg(F.max("e").alias("length_ms"))
    return clean_segments(noise, lengths)


def pipeline_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Stage B over all segments with both excerpts."""
    own, pulses = channel_arrays(spark, d, "ecg").select(*SEG, F.col("fs").alias("ecg_rate"), F.col("x").alias("ecg")), channel_arrays(spark, d)
    own = own.join(pulses.select(*SEG), SEG, "left_semi")
    return beats_and_pairs(own, pulses).select(*SEG, rounded("r_sec").alias("r_sec"), rounded("ppg_sec").alias("ppg_sec"), "how")


def pipeline_features(spark: SparkSession, d: str) -> DataFrame:
    """Stage C over all pulse wave excerpts."""
    rows = beat_features(channel_arrays(spark, d))
    return rows.select(*SEG, "beat_no", "n_samples", "peak_offset", *(rounded(c).alias(c) for c in ("peak_value", "area", "up_50", "down_50")))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream: tumbling statistics by type and hour."""
    from pulseloom.streaming.windows import run_to_table, shared_folder, tumbling_statistics

    schema = load(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet").withColumn("at", F.col("ts").cast("timestamp"))
    rows = tumbling_statistics(events, ["event_type"], "at", "value", "1 hour", "30 days")
    done = run_to_table(rows, shared_folder(spark, "stream"), ["event_type", "window_start"])
    return done.select("event_type", F.unix_timestamp("window_start").alias("window_start"), "n", rounded("total", 4).alias("total"), rounded("least").alias("least"), rounded("largest").alias("largest"))


STREAM_SQL = """SELECT event_type, floor(epoch(ts) / 3600)::BIGINT * 3600 AS window_start, count(*) AS n, round(sum(value), 4) AS total, round(min(value), 6) AS least, round(max(value), 6) AS largest
FROM events GROUP BY ALL"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (pipeline_segments, pipeline_pairs, pipeline_features, stream_windows)}


def oracle_sql() -> dict[str, str]:
    return {"stream_windows": STREAM_SQL}
