"""A splittable source of signals: files cut into byte ranges, a task each.

``spark.read.format("signals")`` gives the long form of WAV, RF64, TDMS, HDF5 and MAT
7.3 files, with a task for every ``sliceBytes`` of a file; no task or driver holds
a file.  The driver lists names and sizes only: each task walks its file's headers
and reads the samples that begin in its range.

Filters on ``channel`` (=, in) and on ``i`` (<, <=, >, >=, =) reach the reader: other
channels are not decoded, other sample ranges not read.

``df.write.format("signals")`` writes the long form as WAV files of 64-bit floats, one
for each run of consecutive samples of a channel; named after signal, channel and
first sample, so a task that runs again writes the same files.  Rows should come
sorted by (signal_id, channel, i).
"""

from __future__ import annotations

import fnmatch
import struct
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from ..errors import UnsupportedFormat
from .blocks import Layout, tdms_layout, wav_layout
from .hdf5 import hdf5_layout

SCHEMA = "signal_id string, channel int, channel_name string, sample_rate double, unit string, source_path string, i bigint, value double"
LAYOUTS = {".wav": wav_layout, ".tdms": tdms_layout, ".h5": hdf5_layout, ".hdf5": hdf5_layout, ".mat": hdf5_layout}
SLICE_BYTES = 64 << 20
#: Files that one task opens, at most.
OPENING = 64


def _system(path: str) -> tuple[pfs.FileSystem, str]:
    return pfs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pfs.LocalFileSystem(), path)


def _extension(path: str) -> str:
    return "." + path.rsplit("/", 1)[-1].rpartition(".")[2].lower()


@contextmanager
def opened(path: str):
    system, name = _system(path)
    with system.open_input_file(name) as f:
        yield f


def listed(path: str) -> list[tuple[str, int]]:
    """The files under a path (a file, a folder, or a pattern for the last name)."""
    system, name = _system(path)
    folder, _, pattern = name.rpartition("/")
    if any(c in pattern for c in "*?["):
        found = [i for i in system.get_file_info(pfs.FileSelector(folder or ".")) if fnmatch.fnmatch(i.base_name, pattern)]
    else:
        info = system.get_file_info(name)
        if info.type == pfs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = system.get_file_info(pfs.FileSelector(name, recursive=True)) if info.type == pfs.FileType.Directory else [info]
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    return sorted((prefix + i.path, i.size) for i in found if i.type == pfs.FileType.File and _extension(i.path) in LAYOUTS and not i.base_name.startswith(("_", ".")))


def layout(path: str, f, size: int) -> Layout:
    extension = _extension(path)
    if extension not in LAYOUTS:
        raise UnsupportedFormat(f"no splittable reader for {extension!r}")
    return LAYOUTS[extension](f, size)


@dataclass
class Slice:
    path: str
    size: int
    low: int
    high: int


@dataclass
class Slices(InputPartition):
    """A task's work: one slice of a large file, or many small files."""

    slices: list[Slice]


class SignalReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("slicebytes", SLICE_BYTES))
        self.rate = options.get("samplerate")
        self.start, self.stop, self.channels = 0, None, None

    def pushFilters(self, filters):
        for f in filters:
            name, value = ".".join(f.attribute) if hasattr(f, "attribute") else "", getattr(f, "value", None)
            if name == "channel" and isinstance(f, EqualTo):
                self._only({value})
            elif name == "channel" and isinstance(f, In):
                self._only(set(value))
            elif name == "i" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.start = max(self.start, value + isinstance(f, GreaterThan))
            elif name == "i" and isinstance(f, (LessThan, LessThanOrEqual)):
                self._until(value + isinstance(f, LessThanOrEqual))
            elif name == "i" and isinstance(f, EqualTo):
                self.start = max(self.start, value)
                self._until(value + 1)
            elif not (name in ("channel", "i") and isinstance(f, IsNotNull)):  # these never are
                yield f

    def _only(self, channels: set) -> None:
        self.channels = channels if self.channels is None else self.channels & channels

    def _until(self, stop: int) -> None:
        self.stop = stop if self.stop is None else min(self.stop, stop)

    def partitions(self) -> list[InputPartition]:
        """Small files go together, each counting OPENING of a slice at least."""
        groups: list[list[Slice]] = []
        room = 0
        for path, size in listed(self.path):
            for a in range(0, size, self.step):
                part = Slice(path, size, a, min(a + self.step, size))
                cost = max(part.high - part.low, self.step // OPENING)
                if cost > room or not groups:
                    groups.append([])
                    room = self.step
                groups[-1].append(part)
                room -= cost
        return [Slices(g) for g in groups] or [Slices([])]

    def read(self, task: Slices) -> Iterator[pa.RecordBatch]:
        for part in task.slices:
            yield from self._read(part)

    def _read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        base = part.path.rsplit("/", 1)[-1]
        signal, channel, first = written_name(base) or (base, 0, 0)
        wanted = None if self.channels is None else {c - channel for c in self.channels}
        stop = None if self.stop is None else self.stop - first
        with opened(part.path) as f:
            found = layout(part.path, f, part.size)
            rate = float(self.rate or found.rate or 1.0)
            for block in found.blocks:
                for piece in block.read(f, part.low, part.high, max(0, self.start - first), stop, wanted):
                    n = len(piece.values)
                    same = lambda v, kind, n=n: pa.repeat(pa.scalar(v, kind), n)
                    yield pa.RecordBatch.from_arrays(
                        [
                            same(signal, pa.string()), same(piece.channel + channel, pa.int32()), same(piece.name, pa.string()), same(rate, pa.float64()),
                            same(found.unit, pa.string()), same(part.path, pa.string()), pa.array(np.arange(piece.first + first, piece.first + first + n)), pa.array(piece.values),
                        ],
                        names=["signal_id", "channel", "channel_name", "sample_rate", "unit", "source_path", "i", "value"],
                    )


def file_name(signal: str, channel: int, first: int) -> str:
    return f"{quote(signal, safe='')}@{channel}@{first}.wav"


def written_name(name: str) -> tuple[str, int, int] | None:
    """Signal, channel and first sample of a name by :func:`file_name`."""
    parts = name.removesuffix(".wav").split("@")
    if len(parts) != 3 or not name.endswith(".wav") or not all(p.isdecimal() for p in parts[1:]):
        return None
    return unquote(parts[0]), int(parts[1]), int(parts[2])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class SignalWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.rate, self.overwrite = options["path"].rstrip("/"), float(options.get("samplerate", 1.0)), overwrite
        self.at = [schema.fieldNames().index(c) for c in ("signal_id", "channel", "i", "value")]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _system(self.path)
        system.create_dir(folder, recursive=True)
        out, files, next_ = None, [], None
        try:
            for batch in batches:
                signal, channel, i, value = (batch.column(k) for k in self.at)
                i, value = i.to_numpy(), value.to_numpy(zero_copy_only=False).astype("<f8")
                own = np.array([f"{s}\0{c}" for s, c in zip(signal.to_pylist(), channel.to_pylist(), strict=True)], object)
                cuts = [0, *(1 + np.flatnonzero((own[1:] != own[:-1]) | (np.diff(i) != 1))).tolist(), len(i)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if a == b:
                        continue
                    if out is None or next_ != (own[a], i[a]):
                        if out:
                            _closed(out, system, files[-1], self.rate)
                        files.append(f"{folder}/{file_name(signal[a].as_py(), channel[a].as_py(), int(i[a]))}")
                        out = [system.open_output_stream(files[-1] + ".part"), 0]
                        out[0].write(_header(self.rate, 0xFFFFFFFF))
                    out[0].write(value[a:b].tobytes())
                    out[1] += b - a
                    next_ = (own[a], i[a] + b - a)
            if out:
                _closed(out, system, files[-1], self.rate)
        except BaseException:
            if out:
                out[0].close()
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Files of an earlier write stay unless the mode is overwrite."""
        system, folder = _system(self.path)
        system.create_dir(folder, recursive=True)
        keep = {f for m in messages if m for f in m.files}
        for info in system.get_file_info(pfs.FileSelector(folder)):
            stale = info.base_name.endswith(".part") or self.overwrite and written_name(info.base_name)
            if stale and info.path not in keep:
                system.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _system(self.path)
        for name in (f for m in messages if m for f in m.files):
            if system.get_file_info(name).type == pfs.FileType.File:
                system.delete_file(name)


def _header(rate: float, size: int) -> bytes:
    """Open-ended sizes: a reader takes what the file has."""
    form = struct.pack("<HHIIHH", 3, 1, round(rate), round(rate) * 8, 8, 64)
    return b"RIFF" + struct.pack("<I", 0xFFFFFFFF) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", size)


def _closed(out: list, system: pfs.FileSystem, name: str, rate: float) -> None:
    out[0].close()
    system.move(name + ".part", name)


class SignalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "signals"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SignalReader:
        return SignalReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> SignalWriter:
        return SignalWriter({k.lower(): v for k, v in self.options.items()}, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session; filters reach it from then on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SignalSource)


def read_slices(spark: SparkSession, path: str, slice_bytes: int = SLICE_BYTES, sample_rate: float | None = None) -> DataFrame:
    """The long form of the files under ``path``."""
    register(spark)
    reader = spark.read.format("signals").option("sliceBytes", slice_bytes)
    return (reader if sample_rate is None else reader.option("sampleRate", sample_rate)).load(path)


def write_slices(samples: DataFrame, path: str, sample_rate: float = 1.0, mode: str = "append") -> None:
    register(samples.sparkSession)
    samples.select("signal_id", "channel", "i", "value").write.format("signals").option("sampleRate", sample_rate).mode(mode).save(path)
