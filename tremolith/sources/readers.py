"""File readers: by extension, each file parsed where Spark reads it.

CSV/TXT, WAV, MAT, UFF (type 58), TDMS and HDF5 are parsed from the file's bytes;
FLAC and MP3 need a library and are refused with a clear error where it is missing.
A file is one row here, and so one task's work; :mod:`.slices` reads large ones by
byte ranges.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SignalReadError, UnsupportedFormat
from ..model import SIGNALS
from .blocks import Layout, tdms_layout
from .hdf5 import SIGNATURE, hdf5_layout

#: What a parser returns: channel data [channel, sample], names, rate or None, unit.
Parsed = tuple[np.ndarray, list[str] | None, float | None, str]
# The names under which files state their sample rate.
RATE_NAMES = ("fs", "sample_rate", "sampling_rate", "srate", "sr", "rate")


def parse_csv(raw: bytes) -> Parsed:
    lines = [r for r in raw.decode("utf-8-sig").splitlines() if r.strip()]
    names = [c.strip() for c in lines[0].split(",")]
    return np.array([[float(c) for c in r.split(",")] for r in lines[1:]]).reshape(-1, len(names)).T, names, None, ""


def parse_wav(raw: bytes) -> Parsed:
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise SignalReadError("no RIFF/WAVE header")
    at, form, data = 12, None, b""
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack("<I", raw[at + 4 : at + 8])[0]
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", raw[at + 8 : at + 24])
        elif name == b"data":
            data = raw[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None:
        raise SignalReadError("no format chunk")
    kind, channels, rate, _, _, bits = form
    if kind == 3:
        x = np.frombuffer(data, f"<f{bits // 8}").astype(float)
    elif bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    elif bits == 24:
        b = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000
        x = x / 2.0**23
    else:
        x = np.frombuffer(data, f"<i{bits // 8}") / 2.0 ** (bits - 1)
    return x[: len(x) // channels * channels].reshape(-1, channels).T, None, float(rate), "Pa"


_MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2"}


def _mat_elements(raw: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(raw):
        kind, size = struct.unpack(order + "II", raw[at : at + 8])
        if kind >> 16:  # the small form: size and data within eight bytes
            kind, size = kind & 0xFFFF, kind >> 16
            yield kind, raw[at + 4 : at + 4 + size]
            at += 8
            continue
        body = raw[at + 8 : at + 8 + size]
        if kind == 15:
            yield from _mat_elements(zlib.decompress(body), order)
            at += 8 + size
        else:
            yield kind, body
            at += 8 + size + (-size) % 8


def parse_mat(raw: bytes) -> Parsed:
    if raw[:8] == SIGNATURE or raw[512:520] == SIGNATURE:  # MAT 7.3
        return parse_hdf5(raw)
    order = "<" if raw[126:128] == b"IM" else ">"
    arrays: dict[str, np.ndarray] = {}
    for kind, body in _mat_elements(raw[128:], order):
        if kind != 14:
            continue
        parts = list(_mat_elements(body, order))
        if len(parts) < 4 or parts[3][0] not in _MAT_TYPES:
            continue
        shape = np.frombuffer(parts[1][1], order + "i4")
        value = np.frombuffer(parts[3][1], order + _MAT_TYPES[parts[3][0]]).astype(float)
        if value.size == np.prod(shape):
            arrays[parts[2][1].decode()] = value.reshape(shape, order="F")
    if not arrays:
        raise SignalReadError("no numeric array")
    rate = next((float(arrays[k].ravel()[0]) for k in RATE_NAMES if k in arrays and arrays[k].size), None)
    x = max(arrays.values(), key=lambda a: a.size)
    x = x.reshape(1, -1) if min(x.shape) == 1 else x.reshape(x.shape[0], -1)
    return (x.T if x.shape[0] > x.shape[1] else x), None, rate, ""


def parse_uff(raw: bytes) -> Parsed:
    lines, channels, rate = raw.decode("ascii", "replace").splitlines(), [], None
    marks = [i for i, r in enumerate(lines) if r.strip() == "-1"]
    for a, b in zip(marks[::2], marks[1::2], strict=False):
        part = lines[a + 1 : b]
        if not part or part[0].strip() != "58":
            continue
        head = part[7].split()
        kind, count, even, step = int(head[0]), int(head[1]), int(head[2]), float(head[4])
        numbers = np.array(" ".join(part[12:]).split(), float)
        width = (2 if kind in (5, 6) else 1) + (0 if even else 1)
        x = numbers[: count * width].reshape(-1, width)
        channels.append(x[:, 0 if even else 1])
        rate = 1 / step if even and step else (1 / (x[1, 0] - x[0, 0]) if not even and len(x) > 1 else rate)
    if not channels:
        raise SignalReadError("no dataset of type 58")
    n = min(map(len, channels))
    return np.stack([c[:n] for c in channels]), None, rate, ""


def _laid_out(found: Layout, raw: bytes) -> Parsed:
    """All channels of a file whose layout is known, cut to the shortest."""
    pieces: dict[int, list] = {}
    for block in found.blocks:
        for p in block.read(io.BytesIO(raw), 0, len(raw)):
            pieces.setdefault(p.channel, []).append(p)
    if not pieces:
        raise SignalReadError("no channel data")
    channels = [np.concatenate([p.values for p in sorted(pieces[c], key=lambda p: p.first)]) for c in sorted(pieces)]
    n = min(map(len, channels))
    return np.stack([c[:n] for c in channels]), [pieces[c][0].name for c in sorted(pieces)], found.rate, found.unit


def parse_tdms(raw: bytes) -> Parsed:
    return _laid_out(tdms_layout(io.BytesIO(raw), len(raw)), raw)


def parse_hdf5(raw: bytes) -> Parsed:
    return _laid_out(hdf5_layout(io.BytesIO(raw), len(raw)), raw)


def parse_compressed_audio(raw: bytes) -> Parsed:
    try:
        import soundfile
    except ImportError:
        raise UnsupportedFormat("FLAC and MP3 need the soundfile library") from None
    x, rate = soundfile.read(io.BytesIO(raw), always_2d=True)
    return x.T, None, float(rate), "Pa"


PARSERS: dict[str, Callable[[bytes], Parsed]] = {
    ".csv": parse_csv, ".txt": parse_csv, ".mat": parse_mat, ".wav": parse_wav, ".flac": parse_compressed_audio, ".mp3": parse_compressed_audio,
    ".h5": parse_hdf5, ".hdf5": parse_hdf5, ".tdms": parse_tdms, ".uff": parse_uff, ".unv": parse_uff,
}


def register(extension: str, parser: Callable[[bytes], Parsed]) -> None:
    PARSERS[extension.lower()] = parser


def parser_for(path: str) -> Callable[[bytes], Parsed]:
    extension = "." + path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if extension not in PARSERS:
        raise UnsupportedFormat(f"no reader for {extension!r}")
    return PARSERS[extension]


def read_signals(spark: SparkSession, path: str, channel: int | None = None, sample_rate: float | None = None) -> DataFrame:
    """Array form of the files under ``path`` (a file, folder or glob; Parquet is
    read as it is).  A given rate or channel wins over the file."""
    if path.rstrip("/").endswith(".parquet"):
        found = spark.read.parquet(path)
        found = found if sample_rate is None else found.withColumn("sample_rate", F.lit(float(sample_rate)))
        return found if channel is None else found.filter(F.col("channel") == channel)
    if "." in path.rsplit("/", 1)[-1]:
        parser_for(path)  # an unknown extension fails before any job

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for where, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, names, rate, unit = parser_for(where)(raw)
                for c in range(len(x)) if channel is None else [channel]:
                    rows.append(
                        {
                            "signal_id": where.rsplit("/", 1)[-1], "channel": c, "channel_name": names[c] if names else f"ch_{c}", "sample_rate": sample_rate or rate or 1.0,
                            "unit": unit, "source_path": where, "metadata": [], "samples": x[c].tolist(),
                        }
                    )
            kinds = {"signal_id": pa.string(), "channel": pa.int32(), "channel_name": pa.string(), "sample_rate": pa.float64(), "unit": pa.string(), "source_path": pa.string()}
            schema = pa.schema([*kinds.items(), ("metadata", pa.map_(pa.string(), pa.string())), ("samples", pa.list_(pa.float64()))])
            yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, SIGNALS)
