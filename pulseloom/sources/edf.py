"""European Data Format files as a Spark data source, and a writer for single files.

The header has 256 bytes and then 256 for each signal, stored field by field; data records hold each signal's 16-bit
samples one behind the other. An input partition is a range of data records of one file; it reads the wanted signals'
bytes of each record only.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pulseloom.sources.recording_bin import CHUNK_SCHEMA, stem

# The widths of the header's fields, in order.
FILE_FIELDS = {"version": 8, "patient": 80, "recording": 80, "date": 8, "time": 8, "header_bytes": 8, "reserved": 44, "records": 8, "record_sec": 8, "signals": 4}
SIGNAL_FIELDS = {"label": 16, "transducer": 80, "unit": 8, "physical_min": 8, "physical_max": 8, "digital_min": 8, "digital_max": 8, "filter": 80, "samples": 8, "reserved": 32}


@dataclass
class Signal:
    """One signal's place in a data record and its scale."""

    label: str
    unit: str
    offset: int
    samples: int
    scale: float
    shift: float


def read_header(path: str) -> tuple[int, int, float, int, list[Signal]]:
    """(header bytes, data records, seconds a record, bytes a record, signals). Unknown record counts follow from the file's size."""
    with open(path, "rb") as file:
        text = file.read(256).decode("latin-1")
        top, at = {}, 0
        for name, width in FILE_FIELDS.items():
            top[name] = text[at : at + width].strip()
            at += width
        n = int(top["signals"])
        text, at, columns = file.read(256 * n).decode("latin-1"), 0, {}
        for name, width in SIGNAL_FIELDS.items():
            columns[name] = [text[at + i * width : at + (i + 1) * width].strip() for i in range(n)]
            at += n * width
    signals, offset = [], 0
    for i in range(n):
        low, high, dlow, dhigh = (float(columns[c][i]) for c in ("physical_min", "physical_max", "digital_min", "digital_max"))
        scale = (high - low) / (dhigh - dlow) if dhigh != dlow else 0.0
        samples = int(columns["samples"][i])
        signals.append(Signal(columns["label"][i], columns["unit"][i], offset, samples, scale, low - scale * dlow))
        offset += 2 * samples
    size, records = int(top["header_bytes"]), int(top["records"])
    if records < 0:
        records = (os.path.getsize(path) - size) // max(1, offset)
    return size, records, float(top["record_sec"]), offset, signals


def plain_label(label: str) -> str:
    """A label without anything but letters, digits and underscores."""
    return re.sub(r"\W", "", label)


class _Range(InputPartition):
    def __init__(self, path: str, low: int, high: int, chunk_no: int) -> None:
        super().__init__((path, low))
        self.path, self.low, self.high, self.chunk_no = path, low, high, chunk_no


class EdfReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = sorted(glob.glob(options["path"], recursive=True))
        self.wanted = [s.strip().upper() for s in options["signals"].split(",")] if options.get("signals") else None
        self.chunk_sec = float(options.get("chunkseconds", options.get("chunkSeconds", 3_600)))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            _, records, seconds, _, _ = read_header(path)
            step = max(1, int(self.chunk_sec / seconds)) if seconds > 0 else max(1, records)
            out += [_Range(path, low, min(low + step, records), k) for k, low in enumerate(range(0, records, step))]
        return out

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        head, _, seconds, width, signals = read_header(part.path)
        used: set[str] = set()
        with open(part.path, "rb") as file:
            for signal in signals:
                name = plain_label(signal.label)
                if name in used or self.wanted and not any(w in signal.label.upper() for w in self.wanted):
                    continue
                used.add(name)
                pieces = []
                for record in range(part.low, part.high):
                    file.seek(head + record * width + signal.offset)
                    pieces.append(np.frombuffer(file.read(2 * signal.samples), "<i2"))
                x = np.concatenate(pieces).astype(float) * signal.scale + signal.shift
                yield pa.record_batch(
                    [
                        pa.array([stem(part.path)]), pa.array([name]), pa.array([part.chunk_no], pa.int32()), pa.array([part.low * signal.samples], pa.int64()),
                        pa.array([signal.samples / seconds if seconds else 0.0]), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)),
                    ],
                    names=["rec_id", "channel", "chunk_no", "start_idx", "fs", "samples"],
                )


class EdfSource(DataSource):
    """``spark.read.format("edf_signals")`` with options path (a glob), signals (parts of labels) and chunkSeconds.

    Values are not clamped to the physical range; of several signals with one label the first is read.
    """

    @classmethod
    def name(cls) -> str:
        return "edf_signals"

    def schema(self) -> str:
        return CHUNK_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return EdfReader(self.options)


def unit_of(label: str) -> str:
    """Physical unit by a signal's name."""
    upper = label.upper()
    if "PPG" in upper or "PLETH" in upper:
        return ""
    if "SPO2" in upper:
        return "%"
    return "mmHg" if any(p in upper for p in ("ABP", "CVP", "ART")) else "mV"


def write_edf(path: str, signals: dict[str, tuple[float, np.ndarray]], record_sec: float = 1.0) -> None:
    """Write signals as {label: (rate, samples)}; the last record is padded with the least value."""
    specs, records = [], 0
    for label, (rate, x) in signals.items():
        per = int(round(rate * record_sec))
        x = np.asarray(x, float)
        low, high = (float(x.min()), float(x.max())) if len(x) else (0.0, 1.0)
        if low == high:
            high = low + 1.0
        low, high = float(f"{low:.6g}"[:8]), float(f"{high:.6g}"[:8])
        specs.append((label, per, low, high, x))
        records = max(records, -(-len(x) // per))
    text = lambda v, width: str(v)[:width].ljust(width)
    values = {"version": 0, "patient": "X", "recording": "X", "date": "01.01.00", "time": "00.00.00", "header_bytes": 256 * (1 + len(specs)), "reserved": "", "records": records, "record_sec": f"{record_sec:g}", "signals": len(specs)}
    head = "".join(text(values[name], width) for name, width in FILE_FIELDS.items())
    per_signal = [
        {"label": s[0], "transducer": "", "unit": unit_of(s[0]), "physical_min": f"{s[2]:g}", "physical_max": f"{s[3]:g}", "digital_min": -32768, "digital_max": 32767, "filter": "", "samples": s[1], "reserved": ""} for s in specs
    ]
    head += "".join("".join(text(p[name], width) for p in per_signal) for name, width in SIGNAL_FIELDS.items())
    coded = []
    for _, per, low, high, x in specs:
        y = np.full(records * per, low)
        y[: len(x)] = x
        coded.append(np.clip(np.rint((y - low) / (high - low) * 65535 - 32768), -32768, 32767).astype("<i2").reshape(records, per))
    with open(path, "wb") as file:
        file.write(head.encode("latin-1"))
        for k in range(records):
            for c in coded:
                file.write(c[k].tobytes())
