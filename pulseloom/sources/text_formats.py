"""Text formats: delimited signals, sleep staging XML, noise markings, configuration and metadata files."""

from __future__ import annotations

import csv
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.functions.common import quoted
from pulseloom.sources.recording_bin import stem


def _id_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_delimited_signal(spark: SparkSession, path: str, label: str, *, index: str = "Index", separator: str = ",") -> DataFrame:
    """A column of delimited text files as (rec_id, idx, value).

    A file's header is its line that holds ``index`` or ``label``; the wanted column is the first whose header contains
    ``label``. Cells that are no numbers are dropped; ``idx`` is the index column's value, so lines may be read in any
    order and by any task. Files without such a header give no rows.
    """
    lines = spark.read.text(path).select(_id_of(F.col("_metadata.file_path")).alias("rec_id"), F.split("value", separator).alias("cells"))
    trimmed = F.transform("cells", lambda c: F.trim(F.replace(c, F.lit('"'), F.lit(""))))
    lines = lines.withColumn("cells", trimmed)
    place = lambda part: F.array_position(F.transform("cells", lambda c: F.contains(F.upper(c), F.lit(part.upper()))), True)
    heads = lines.where((place(index) > 0) & (place(label) > 0)).groupBy("rec_id").agg(F.min(F.struct(place(index).alias("i"), place(label).alias("v"))).alias("at"))
    cell = lambda n: F.try_element_at("cells", n.cast("int")).try_cast("double")
    rows = lines.join(heads, "rec_id").select("rec_id", cell(F.col("at.i")).cast("bigint").alias("idx"), cell(F.col("at.v")).alias("value"))
    return rows.where("idx is not null and value is not null")


def read_sleep_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sleep staging files as (rec_id, epoch_no, stage, epoch_sec) and (rec_id, name, start_sec, duration_sec)."""
    files = spark.read.text(path, wholetext=True).select(_id_of(F.col("_metadata.file_path")).alias("rec_id"), F.col("value").alias("xml"))
    number = lambda expression: F.expr(f"xpath_string(xml, '{expression}')").try_cast("double")
    stages = files.select("rec_id", number("//EpochLength").alias("epoch_sec"), F.posexplode(F.expr("xpath(xml, '//SleepStage/text()')")).alias("epoch_no", "stage"))
    stages = stages.select("rec_id", "epoch_no", F.col("stage").try_cast("int").alias("stage"), "epoch_sec")
    parts = F.arrays_zip(*(F.expr(f"xpath(xml, '//ScoredEvent/{tag}/text()')").alias(tag) for tag in ("Name", "Start", "Duration")))
    events = files.select("rec_id", F.explode(parts).alias("e"))
    return stages, events.select("rec_id", F.col("e.Name").alias("name"), F.col("e.Start").try_cast("double").alias("start_sec"), F.col("e.Duration").try_cast("double").alias("duration_sec"))


NOISE_SCHEMA = "start_sample long, end_sample long, start_sec double, end_sec double, label string, marking_type string"


def read_noise_csv(spark: SparkSession, path: str) -> DataFrame:
    """Noise marking files with their recording's id; the last column's name may have a blank in front."""
    rows = spark.read.csv(path, header=True, schema=NOISE_SCHEMA, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)
    return rows.select(_id_of(F.col("_metadata.file_path")).alias("rec_id"), "*")


def write_noise_csv(df: DataFrame, path: str) -> None:
    """Markings as CSV with three decimals in seconds, one folder for each recording."""
    text = lambda c: F.format_string("%.3f", c).alias(c)
    df.select("rec_id", "start_sample", "end_sample", text("start_sec"), text("end_sec"), "label", "marking_type").write.partitionBy("rec_id").mode("overwrite").csv(path, header=True)


def read_noise_binary(spark: SparkSession, path: str) -> DataFrame:
    """Binary noise markings: a count, then six doubles a row; label and type are codes, 0 is an unknown one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                (n,) = struct.unpack_from("<Q", content)
                x = np.frombuffer(content, "<f8", 6 * n, 8).reshape(n, 6)
                whole = [pa.array(x[:, k].astype(np.int64)) for k in (0, 1)]
                codes = [pa.array(x[:, k].astype(np.int32)) for k in (4, 5)]
                yield pa.record_batch([pa.array([stem(file)] * n), *whole, pa.array(x[:, 2]), pa.array(x[:, 3]), *codes], names=["rec_id", "start_sample", "end_sample", "start_sec", "end_sec", "label_id", "type_id"])

    schema = "rec_id string, start_sample long, end_sample long, start_sec double, end_sec double, label_id int, type_id int"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


# Names of the channels in amplifier exports.
LEAD_NAMES = {"I": "ECG I", "II": "EKG", "III": "ECG III"}


def read_amplifier_export(spark: SparkSession, path: str) -> DataFrame:
    """Exports of doubles (``x.bin``, all channels of a sample together) beside a text header (``x.inf``).

    Returns (rec_id, channel, fs, samples); channels are cut to whole seconds. ``path`` is a glob of the headers.
    """
    import glob

    heads = spark.createDataFrame([(p, os.path.splitext(p)[0] + ".bin") for p in sorted(glob.glob(path))], "head string, data string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for head, data in zip(batch.column("head").to_pylist(), batch.column("data").to_pylist(), strict=True):
                fs, names = parse_amplifier_header(open(head, encoding="latin-1").read())
                x = np.fromfile(data, "<f8")
                x = x[: len(x) // len(names) * len(names)].reshape(-1, len(names))
                x = x[: int(len(x) // fs * fs)]
                yield pa.record_batch(
                    [pa.array([stem(head)] * len(names)), pa.array(names), pa.array([float(fs)] * len(names)), pa.array(list(x.T), pa.list_(pa.float64()))], names=["rec_id", "channel", "fs", "samples"]
                )

    return heads.repartition(max(1, min(heads.count(), 1000))).mapInArrow(run, "rec_id string, channel string, fs double, samples array<double>")


def parse_amplifier_header(text: str) -> tuple[float, list[str]]:
    """(rate, channel names) of an export's header: a rate line and one numbered line for each channel."""
    fs, names, in_channels = 0.0, [], False
    for line in text.splitlines():
        key, _, value = line.partition("=")
        if "rate" in key.lower() and value:
            fs = float("".join(c for c in value if c.isdigit() or c == "."))
        elif key.strip().lower().startswith("channel number"):
            in_channels = True
        elif in_channels and line.split() and line.split()[0].isdigit():
            name = line.split(maxsplit=1)[1].strip() if len(line.split()) > 1 else line.split()[0]
            names.append(LEAD_NAMES.get(name, name))
    if not fs or not names:
        raise ValueError("the header names no rate or no channels")
    return fs, names


def read_properties(text: str) -> dict[str, str]:
    """``key = value`` lines; ``#`` begins a comment; later keys win."""
    pairs = (line.split("#", 1)[0].partition("=") for line in text.splitlines())
    return {key.strip(): value.strip() for key, sign, value in pairs if sign and key.strip()}


def dataset_settings(path: str, dataset: str) -> dict[str, str | None]:
    """The row of a settings table for one dataset; missing last cells are None and a missing PPG rate is the ECG rate."""
    with open(path, newline="", encoding="utf-8") as file:
        head, *rows = list(csv.reader(file))
    names = [h.strip() for h in head]
    for row in rows:
        if row and row[0].strip().lower() == dataset.lower():
            found: dict[str, str | None] = {n: (row[i].strip() or None) if i < len(row) else None for i, n in enumerate(names)}
            if "ppg_rate" in found and found["ppg_rate"] is None:
                found["ppg_rate"] = found.get("ecg_rate")
            return found
    raise KeyError(dataset)


def read_metadata(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Named columns of a CSV file with their types; other columns are ignored and cells that don't fit are null."""
    raw = spark.read.csv(path, header=True)
    return raw.select(*(quoted(c).try_cast(kind).alias(c) for c, kind in columns.items()))
