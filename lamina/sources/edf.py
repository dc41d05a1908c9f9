"""Recordings of many channels as a Spark data source: EDF, EDF+, BDF, BDF+ and BrainVision files.

    spark.dataSource.register(Recording)
    spark.read.format("recording").option("channels", "Fp1,Fp2").load("rest.edf")

Such files are rows of fixed size after a header: a partition is a run of them, read by one byte range, so a night of recording is read
by as many tasks as it has runs. The driver reads headers only.

kind signal (the default): channel, i (sample), t (seconds), value in the channel's unit, scaled from digital to physical values.
kind events: onset, duration (null if there is none), text, of annotation channels or a marker file. `channels` takes some channels.

Cases: a count of records that the header leaves open follows from the file's size, and an incomplete last record is left out; records
of discontinuous files begin when their own time stamp says; a channel without a range (equal digital limits) keeps digital values;
channels with equal names get #1, #2 at the end; a channel that is not there is a KeyError with the names that are."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .byte_ranges import Bytes

#: Bytes that a partition has by default.
PART = 16 << 20
#: The widths of the fields that each channel has in an EDF header, in order.
FIELDS = (("label", 16), ("transducer", 80), ("unit", 8), ("low", 8), ("high", 8), ("digital_low", 8), ("digital_high", 8), ("filter", 80), ("samples", 8), ("reserved", 32))
#: BrainVision's binary formats.
FORMATS = {"INT_16": "<i2", "UINT_16": "<u2", "IEEE_FLOAT_32": "<f4", "INT_32": "<i4"}


@dataclass
class Channel:
    name: str
    samples: int
    scale: float
    offset: float
    at: int
    marks: bool = False


@dataclass
class Layout:
    """Where the records of a file are, and what is in each."""

    path: str
    start: int
    record: int
    count: int
    seconds: float
    channels: list[Channel]
    dtype: str
    interleaved: bool = False
    stamped: bool = False
    markers: str = ""

    def __post_init__(self):
        seen, all_of = Counter(), Counter(c.name for c in self.channels)
        for c in self.channels:
            if all_of[c.name] > 1:
                seen[c.name] += 1
                c.name = f"{c.name}#{seen[c.name]}"


def edf_layout(path: str) -> Layout:
    b = Bytes(path)
    head = b.read(0, 256)
    text = lambda x, y: head[x:y].decode("latin-1").strip()
    width = 3 if head[:1] == b"\xff" else 2
    if width == 2 and text(0, 8) != "0":
        raise ValueError(f"{path} is neither EDF nor BDF")
    n, size = int(text(252, 256)), int(text(184, 192))
    raw, at, fields = b.read(256, size - 256), 0, {}
    for name, w in FIELDS:
        fields[name] = [raw[at + i * w : at + (i + 1) * w].decode("latin-1").strip() for i in range(n)]
        at += n * w
    channels, at = [], 0
    for i in range(n):
        low, high, dlow, dhigh = (float(fields[k][i] or 0) for k in ("low", "high", "digital_low", "digital_high"))
        scale = (high - low) / (dhigh - dlow) if dhigh != dlow else 1.0
        marks = fields["label"][i] in ("EDF Annotations", "BDF Annotations")
        channels.append(Channel(fields["label"][i], int(fields["samples"][i]), scale, low - dlow * scale if dhigh != dlow else 0.0, at, marks))
        at += channels[-1].samples * width
    records = int(text(236, 244))
    whole = (b.size - size) // at if at else 0
    return Layout(path, size, at, min(records, whole) if records >= 0 else whole, float(text(244, 252)), channels, f"i{width}", stamped=text(192, 197).endswith("+D"))


def vision_layout(path: str) -> Layout:
    b = Bytes(path)
    text = b.read(0, b.size).decode("utf-8", "replace")
    keys = dict(re.findall(r"^(\w+)=(.*?)\s*$", text, re.M))
    if keys.get("DataOrientation", "MULTIPLEXED").upper() != "MULTIPLEXED" or keys.get("DataFormat", "BINARY").upper() != "BINARY":
        raise NotImplementedError("BrainVision files that are not binary and multiplexed")
    beside = path[: path.rfind("/") + 1]
    dtype = FORMATS[keys["BinaryFormat"].upper()]
    width, n = np.dtype(dtype).itemsize, int(keys["NumberOfChannels"])
    channels = []
    for i in range(n):
        name, _, scale = (keys[f"Ch{i + 1}"].split(",") + ["", ""])[:3]
        channels.append(Channel(name.replace("\\1", ","), 1, float(scale or 1), 0.0, i * width))
    data = beside + keys["DataFile"]
    return Layout(data, 0, n * width, Bytes(data).size // (n * width), float(keys["SamplingInterval"]) / 1e6, channels, dtype, True, markers=beside + keys["MarkerFile"] if keys.get("MarkerFile") else "")


def layout(path: str) -> Layout:
    return vision_layout(path) if path.lower().endswith(".vhdr") else edf_layout(path)


def digital(raw: np.ndarray, dtype: str) -> np.ndarray:
    """Numbers of bytes, whose last axis is the bytes; those of three bytes get their sign."""
    if dtype != "i3":
        return np.ascontiguousarray(raw).view(np.dtype(dtype).newbyteorder("<"))
    v = raw.reshape(*raw.shape[:-1], -1, 3).astype(np.int32)
    v = v[..., 0] | v[..., 1] << 8 | v[..., 2] << 16
    return v - ((v & 0x800000) << 1)


def annotations(raw: bytes) -> Iterator[tuple[float, float | None, str]]:
    """Onset, duration and text of the lists in an annotation channel's bytes; a time stamp of the record has an empty text."""
    for part in re.split(b"\0+", raw):
        if m := re.match(rb"([+-][\d.]+)(?:\x15([\d.]+))?\x14(.*)", part, re.S):
            for text in m[3].removesuffix(b"\x14").split(b"\x14"):
                yield float(m[1]), float(m[2]) if m[2] else None, text.decode("utf-8", "replace")


@dataclass
class Records(InputPartition):
    a: int
    b: int


class Recording(DataSource):
    """The data source; options kind, channels, partition (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return "onset double, duration double, text string" if self.options.get("kind", "signal") == "events" else "channel string, i bigint, t double, value double"

    def reader(self, schema) -> DataSourceReader:
        return RecordingReader(self.options)


class RecordingReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind, self.size = options["path"], options.get("kind", "signal"), int(options.get("partition", PART))
        self.layout = layout(self.path)
        names = [c.name for c in self.layout.channels if not c.marks]
        self.wanted = [x.strip() for x in options["channels"].split(",")] if options.get("channels") else names
        if lost := sorted(set(self.wanted) - set(names)):
            raise KeyError(f"no channel {', '.join(lost)} in {self.path}; there are {', '.join(names)}")

    def partitions(self) -> list[Records]:
        if self.kind == "events" and self.layout.interleaved:
            return [Records(0, 0)]  # a marker file is a few lines of text
        step = max(1, self.size // max(1, self.layout.record))
        return [Records(a, min(a + step, self.layout.count)) for a in range(0, self.layout.count, step)] or [Records(0, 0)]

    def read(self, part: Records) -> Iterator[pa.RecordBatch]:
        if self.kind == "events":
            rows = list(self._markers() if self.layout.interleaved else self._annotations(part))
            yield pa.RecordBatch.from_pylist([dict(zip(("onset", "duration", "text"), r, strict=True)) for r in rows], pa.schema([("onset", pa.float64()), ("duration", pa.float64()), ("text", pa.string())]))
        elif part.b > part.a:
            yield from self._signal(part)

    def _bytes(self, part: Records) -> np.ndarray:
        k = self.layout
        return np.frombuffer(Bytes(k.path).read(k.start + part.a * k.record, (part.b - part.a) * k.record), np.uint8).reshape(-1, k.record)

    def _starts(self, raw: np.ndarray, part: Records) -> np.ndarray:
        """When each record begins."""
        k, at = self.layout, np.arange(part.a, part.b) * self.layout.seconds
        mark = next((c for c in k.channels if c.marks), None)
        if k.stamped and mark:
            width = 3 if k.dtype == "i3" else 2
            for i, row in enumerate(raw):
                at[i] = next((x for x, _, text in annotations(row[mark.at : mark.at + mark.samples * width].tobytes()) if not text), at[i])
        return at

    def _signal(self, part: Records) -> Iterator[pa.RecordBatch]:
        k, raw = self.layout, self._bytes(part)
        starts, width = self._starts(raw, part), 3 if k.dtype == "i3" else np.dtype(k.dtype).itemsize
        for c in k.channels:
            if c.name in self.wanted and not c.marks:
                v = digital(raw[:, c.at : c.at + c.samples * width], k.dtype).reshape(len(raw), c.samples).astype(float) * c.scale + c.offset
                t = starts[:, None] + np.arange(c.samples) * (k.seconds / c.samples)
                at = np.arange(part.a * c.samples, part.b * c.samples)
                yield pa.RecordBatch.from_arrays([pa.array([c.name] * len(at)), pa.array(at), pa.array(t.ravel()), pa.array(v.ravel())], names=["channel", "i", "t", "value"])

    def _annotations(self, part: Records) -> Iterator[tuple]:
        k = self.layout
        marks = [c for c in k.channels if c.marks]
        if marks and part.b > part.a:
            width = 3 if k.dtype == "i3" else 2
            for row in self._bytes(part):
                for c in marks:
                    yield from (x for x in annotations(row[c.at : c.at + c.samples * width].tobytes()) if x[2])

    def _markers(self) -> Iterator[tuple]:
        if self.layout.markers:
            b = Bytes(self.layout.markers)
            for kind, what, place, length in re.findall(r"^Mk\d+=([^,]*),([^,]*),(\d+),(\d+)", b.read(0, b.size).decode("utf-8", "replace"), re.M):
                s = self.layout.seconds
                yield (int(place) - 1) * s, int(length) * s, f"{kind}/{what}" if what else kind


def read(spark: SparkSession, path: str, kind: str = "signal", **options) -> DataFrame:
    """Samples or events of a recording."""
    spark.dataSource.register(Recording)
    return spark.read.format("recording").options(kind=kind, **options).load(path)


def rate(path: str, channel: str | None = None) -> float:
    """Samples a second of a channel, or of the first one."""
    k = layout(path)
    c = next(c for c in k.channels if not c.marks and channel in (None, c.name))
    return c.samples / k.seconds
