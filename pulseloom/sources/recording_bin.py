"""Binary recordings, segments and beat lists as Spark data sources.

A recording file has a 64-byte little-endian header (ECG rate, PPG rate and epoch length as doubles, then the lengths
of five channels as unsigned 64-bit numbers) and the channels' doubles one behind the other. A channel of the single
sample -1 is absent. Files must be readable by all executors under the same path, as on a shared file system.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADER = struct.Struct("<3d5Q")
CHANNELS = ("ecg1", "ecg2", "ecg3", "ppg", "sleep")
CHUNK_SCHEMA = "rec_id string, channel string, chunk_no int, start_idx long, fs double, samples array<double>"


def stem(path: str) -> str:
    """A file's name without folder and extension, as its recording id."""
    return os.path.splitext(os.path.basename(path))[0]


class _Chunk(InputPartition):
    def __init__(self, path: str, channel: str, chunk_no: int, offset: int, start: int, n: int, fs: float) -> None:
        super().__init__((path, channel, chunk_no))
        self.path, self.channel, self.chunk_no, self.offset, self.start, self.n, self.fs = path, channel, chunk_no, offset, start, n, fs


class RecordingBinReader(DataSourceReader):
    """One input partition for each chunk of each wanted channel; a partition seeks to its own bytes only."""

    def __init__(self, options: dict) -> None:
        self.paths = sorted(glob.glob(options["path"], recursive=True))
        self.channels = [c.strip() for c in options.get("channels", ",".join(CHANNELS)).split(",")]
        self.chunk_sec = float(options.get("chunkSeconds", 28_800))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            with open(path, "rb") as file:
                head = file.read(HEADER.size)
            if len(head) < HEADER.size:
                raise ValueError(f"{path} is too short for a recording")
            ecg, ppg, epoch, *sizes = HEADER.unpack(head)
            offset = HEADER.size
            for channel, size in zip(CHANNELS, sizes, strict=True):
                fs = {"ppg": ppg, "sleep": 1 / epoch if epoch else 0.0}.get(channel, ecg)
                if channel in self.channels:
                    step = max(1, int(self.chunk_sec * fs)) if fs > 0 else size
                    for k, start in enumerate(range(0, size, max(1, step))):
                        out.append(_Chunk(path, channel, k, offset, start, min(step, size - start), fs))
                offset += 8 * size
        return out

    def read(self, part: _Chunk) -> Iterator[pa.RecordBatch]:
        with open(part.path, "rb") as file:
            file.seek(part.offset + 8 * part.start)
            x = np.frombuffer(file.read(8 * part.n), "<f8")
        if len(x) < part.n:
            raise ValueError(f"{part.path} ends inside channel {part.channel}")
        if part.start == 0 and part.n == 1 and x[0] == -1.0:
            return
        samples = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
        yield pa.record_batch(
            [pa.array([stem(part.path)]), pa.array([part.channel]), pa.array([part.chunk_no], pa.int32()), pa.array([part.start], pa.int64()), pa.array([part.fs]), samples],
            names=["rec_id", "channel", "chunk_no", "start_idx", "fs", "samples"],
        )


class RecordingBinSource(DataSource):
    """``spark.read.format("recording_bin")`` with options path (a glob), channels (comma separated) and chunkSeconds."""

    @classmethod
    def name(cls) -> str:
        return "recording_bin"

    def schema(self) -> str:
        return CHUNK_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RecordingBinReader(self.options)


def write_recording(path: str, ecg_rate: float, ppg_rate: float, epoch_sec: float, channels: dict[str, np.ndarray]) -> None:
    """Write one recording; missing channels become the single sample -1."""
    data = [np.asarray(channels.get(c, [-1.0]), "<f8") for c in CHANNELS]
    with open(path, "wb") as file:
        file.write(HEADER.pack(ecg_rate, ppg_rate, epoch_sec, *map(len, data)))
        for x in data:
            file.write(x.tobytes())


def _arrays(content: bytes, per_bin: int) -> list[list[np.ndarray]]:
    """The arrays of a counted file: the number of bins, then for each bin ``per_bin`` counted arrays of doubles."""
    (n,), at, out = struct.unpack_from("<Q", content), 8, []
    for _ in range(n):
        row = []
        for _ in range(per_bin):
            (size,) = struct.unpack_from("<Q", content, at)
            row.append(np.frombuffer(content, "<f8", size, at + 8))
            at += 8 + 8 * size
        out.append(row)
    return out


def read_counted(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Files of counted bins as rows (rec_id, seg_id, one array column for each of ``columns``).

    Segment files have the columns ppg, ecg and sleep, beat files one column. Works on any file system Spark reads.
    """
    schema = "rec_id string, seg_id int, " + ", ".join(f"{c} array<double>" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = _arrays(content, len(columns))
                if rows:
                    arrays = [pa.array([r[k] for r in rows], pa.list_(pa.float64())) for k in range(len(columns))]
                    yield pa.record_batch([pa.array([stem(file)] * len(rows)), pa.array(range(len(rows)), pa.int32()), *arrays], names=["rec_id", "seg_id", *columns])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def counted_bytes(bins: list[list[np.ndarray]]) -> bytes:
    """The content of a counted file."""
    out = [struct.pack("<Q", len(bins))]
    for row in bins:
        for x in row:
            out += [struct.pack("<Q", len(x)), np.asarray(x, "<f8").tobytes()]
    return b"".join(out)


def long_samples(chunks: DataFrame) -> DataFrame:
    """Chunks as one row a sample: (rec_id, channel, fs, idx, value); NaN is null."""
    wide = chunks.select("rec_id", "channel", "fs", "start_idx", F.posexplode("samples").alias("at", "x"))
    return wide.select("rec_id", "channel", "fs", (F.col("start_idx") + F.col("at")).alias("idx"), F.nanvl("x", F.lit(None).cast("double")).alias("value"))
