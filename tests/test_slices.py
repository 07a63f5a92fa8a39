"""Files read by byte ranges, in several tasks."""

import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.hdf5_files import File, dataset, group
from tremolith.errors import SignalReadError, UnsupportedFormat
from tremolith.sources import blocks, hdf5, readers, slices

RNG = np.random.default_rng(41)


def long(df):
    """channel to its values in order; checks that sample numbers are dense."""
    found = {}
    for r in df.collect():
        found.setdefault(r["channel"], {})[r["i"]] = r["value"]
    assert all(sorted(x) == list(range(len(x))) for x in found.values())
    return {c: np.array([x[i] for i in range(len(x))]) for c, x in found.items()}


def wav(path, x, bits=16, rate=8000):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(x.shape[0])
        w.setsampwidth(bits // 8)
        w.setframerate(rate)
        w.writeframes(x.T.astype(f"<i{bits // 8}").tobytes())


def tdms(segments, interleaved=False):
    """Segments of (channel, array) lists, each array in two chunks."""
    out = b""
    text = lambda t: struct.pack("<I", len(t)) + t.encode()
    for held in segments:
        meta, data = struct.pack("<I", len(held)), b""
        for name, x in held:
            code = {"f8": 10, "i2": 2}[x.dtype.str[1:]]
            meta += text(f"/'g'/'{name}'") + struct.pack("<IIIQ", 20, code, 1, len(x) // 2) + struct.pack("<I", 2)
            meta += text("wf_increment") + struct.pack("<Id", 10, 0.01) + text("unit") + struct.pack("<I", 0x20) + text("g")
        for half in (0, 1):
            parts = [x[half * (len(x) // 2) : (half + 1) * (len(x) // 2)] for _, x in held]
            if interleaved:
                data += b"".join(b"".join(p[k : k + 1].tobytes() for p in parts) for k in range(len(parts[0])))
            else:
                data += b"".join(p.tobytes() for p in parts)
        out += struct.pack("<4sIIQQ", b"TDSm", 2 | 4 | 8 | (32 if interleaved else 0), 4713, len(meta) + len(data), len(meta)) + meta + data
    return out


def test_wav_in_several_tasks(spark, tmp_path):
    x = RNG.integers(-3000, 3000, (3, 5000))
    wav(tmp_path / "a.wav", x)
    df = slices.read_slices(spark, str(tmp_path / "a.wav"), slice_bytes=4099)  # cuts within frames
    assert df.rdd.getNumPartitions() == 8
    assert all(np.array_equal(v, x[c] / 32768) for c, v in long(df).items())
    r = df.first()
    assert (r["signal_id"], r["sample_rate"], r["unit"]) == ("a.wav", 8000.0, "Pa")
    whole = readers.read_signals(spark, str(tmp_path / "a.wav")).collect()
    assert all(np.array_equal(w["samples"], x[w["channel"]] / 32768) for w in whole)


def test_filters_reach_the_reader(spark, tmp_path):
    x = RNG.integers(-3000, 3000, (2, 4000))
    wav(tmp_path / "a.wav", x)
    df = slices.read_slices(spark, str(tmp_path), slice_bytes=1000)
    some = df.filter("channel = 1 AND i >= 1000 AND i < 1010 AND value < 2").select("i", "value")
    plan = some._jdf.queryExecution().executedPlan().toString()
    kept = plan.split("Filter ")[1].split("\n")[0]
    assert "value" in kept and "channel" not in kept and "1010" not in kept
    assert {r["i"]: r["value"] for r in some.collect()} == {i: x[1][i] / 32768 for i in range(1000, 1010)}
    reader = slices.SignalReader({"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

    rest = list(reader.pushFilters([In(("channel",), (1, 5)), GreaterThan(("i",), 9), LessThanOrEqual(("i",), 11), IsNotNull(("i",)), EqualTo(("value",), 1.0)]))
    assert [type(f) for f in rest] == [EqualTo] and (reader.start, reader.stop, reader.channels) == (10, 12, {1, 5})
    got = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in got) == 2
    assert df.filter("channel = 0 AND channel = 1").count() == 0 and df.filter("i = 17").count() == 2


@pytest.mark.parametrize("bits", [8, 16, 24, 32, "f4", "f8"])
def test_kinds_of_wav(tmp_path, bits):
    import io

    n = 50
    if isinstance(bits, str):
        data, kind, width = RNG.normal(size=n).astype(bits).tobytes(), 3, int(bits[1])
    else:
        data, kind, width = RNG.integers(0, 256, n * bits // 8, np.uint8).tobytes(), 1, bits // 8
    form = struct.pack("<HHIIHH", kind, 1, 100, 0, width, width * 8)
    raw = b"RIFF\0\0\0\0WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(data)) + data
    found = blocks.wav_layout(io.BytesIO(raw), len(raw))
    got = np.concatenate([p.values for a in range(0, len(raw), 13) for b in found.blocks for p in b.read(io.BytesIO(raw), a, a + 13)])
    assert got == pytest.approx(readers.parse_wav(raw)[0][0])
    wide = b"RF64\xff\xff\xff\xffWAVEds64" + struct.pack("<IQQQI", 28, 0, len(data), n, 0) + b"fmt " + struct.pack("<I", 16) + form + b"data\xff\xff\xff\xff" + data
    found = blocks.wav_layout(io.BytesIO(wide), len(wide))
    assert found.blocks[0].count == n
    with pytest.raises(SignalReadError):
        blocks.wav_layout(io.BytesIO(b"nothing at all"), 14)


@pytest.mark.parametrize("interleaved", [False, True])
def test_tdms_in_several_tasks(spark, tmp_path, interleaved):
    one, two = RNG.normal(size=400), RNG.integers(-9, 9, 400).astype("<i2")
    three = RNG.normal(size=100)
    (tmp_path / "a.tdms").write_bytes(tdms([[("x", one), ("y", two)], [("x", three), ("y", two[:100])]], interleaved))
    df = slices.read_slices(spark, str(tmp_path / "*.tdms"), slice_bytes=333)
    assert df.rdd.getNumPartitions() > 10
    got = long(df)
    assert np.array_equal(got[0], np.concatenate([one, three])) and np.array_equal(got[1], np.concatenate([two, two[:100]]))
    assert {(r["channel_name"], r["sample_rate"]) for r in df.select("channel_name", "sample_rate").distinct().collect()} == {("x", 100.0), ("y", 100.0)}
    data, names, rate, _ = readers.parse_tdms((tmp_path / "a.tdms").read_bytes())
    assert np.array_equal(data[0], got[0]) and names == ["x", "y"] and rate == 100.0


def hdf5_cases():
    wide, tall, one = RNG.normal(size=(3, 50)), RNG.integers(-99, 99, (70, 2)).astype("<i4"), RNG.normal(size=90).astype(">f4")
    yield "contiguous", wide, {}
    yield "tall", tall, {}
    yield "compact", one, {"compact": True}
    yield "chunked", wide, {"chunk": (2, 16)}
    yield "tall-deflate", tall, {"chunk": (16, 2), "filters": ("shuffle", "deflate", "sum"), "attributes": [("fs", 250.0)]}
    yield "one-deep", one, {"chunk": (13,), "filters": ("deflate",), "deep": True, "split": True}
    yield "with-holes", one, {"chunk": (10,), "skip": {(20,), (80,)}}


@pytest.mark.parametrize(("name", "x", "how"), list(hdf5_cases()), ids=lambda v: v if isinstance(v, str) else "")
@pytest.mark.parametrize("new", [False, True])
@pytest.mark.parametrize("base", [0, 512])
def test_hdf5(tmp_path, name, x, how, new, base):
    import io

    f = File(base)
    inner = group(f, {"signal": dataset(f, x, new=new, **how), "fs": dataset(f, np.array([125.0]), new=new), "n": dataset(f, np.zeros((2, 2, 2)), new=new)}, new)
    raw = f.finish(group(f, {"data": inner, "small": dataset(f, np.arange(5.0), new=new)}, new), new)
    want = x.astype(float)
    for origin in how.get("skip", ()):
        want[origin[0] : origin[0] + 10] = 0
    want = want.reshape(1, -1) if want.ndim == 1 else want.T if want.shape[0] > want.shape[1] else want
    data, names, rate, unit = readers.parse_hdf5(raw)
    assert np.array_equal(data, want) and names[0] == "data/signal_ch0" and rate == (250.0 if "attributes" in how else 125.0) and unit == "m/s²"
    found = hdf5.hdf5_layout(io.BytesIO(raw), len(raw))
    for step in (7, 100, 10**6):  # whatever the ranges, each sample once
        got = {}
        for a in range(0, len(raw), step):
            for b in found.blocks:
                for p in b.read(io.BytesIO(raw), a, a + step, 3, 45, {0}):
                    for k, v in enumerate(p.values):
                        assert (p.channel, p.first + k) not in got
                        got[p.channel, p.first + k] = v
        assert got == {(0, i): v for i, v in enumerate(want[0]) if 3 <= i < 45}


def test_hdf5_chunks_in_parallel(spark, tmp_path):
    x = RNG.normal(size=(20_000, 2))
    f = File(512)
    (tmp_path / "a.mat").write_bytes(f.finish(group(f, {"x": dataset(f, x.T.copy(), (2, 1000), ("deflate",)), "fs": dataset(f, np.array([[50.0]]))})))
    df = slices.read_slices(spark, str(tmp_path), slice_bytes=30_000)
    assert df.rdd.getNumPartitions() > 8
    got = long(df)
    assert all(np.array_equal(got[c], x[:, c]) for c in (0, 1)) and df.first()["sample_rate"] == 50.0
    tasks = df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 8
    whole = readers.read_signals(spark, str(tmp_path / "a.mat")).collect()
    assert all(np.array_equal(w["samples"], x[:, w["channel"]]) for w in whole)


def test_what_hdf5_refuses():
    import io

    for raw in (b"", b"x" * 3000):
        with pytest.raises(SignalReadError):
            hdf5.hdf5_layout(io.BytesIO(raw), len(raw))
    with pytest.raises(UnsupportedFormat):
        hdf5.hdf5_layout(io.BytesIO(b" " * 124 + b"\0\x01IM" + bytes(600)), 728)
    f = File()
    raw = f.finish(group(f, {"none": group(f, {})}))
    with pytest.raises(SignalReadError):
        hdf5.hdf5_layout(io.BytesIO(raw), len(raw))


def test_written_and_read_back(spark, tmp_path):
    rows = [(s, c, i, None if i == 7 else float(i * c)) for s in ("a/b c", "é") for c in (0, 3) for i in range(40)]
    df = spark.createDataFrame(rows, "signal_id string, channel int, i long, value double").filter("NOT (channel = 3 AND i BETWEEN 20 AND 24)")
    sorted_ = df.repartition(3, "signal_id").sortWithinPartitions("signal_id", "channel", "i")
    for _ in range(2):  # a second writing gives the same files
        slices.write_slices(sorted_, str(tmp_path / "out"), 100.0)
    back = slices.read_slices(spark, str(tmp_path / "out"), 64).select("signal_id", "channel", "i", "value", "sample_rate")
    got = sorted((r["signal_id"], r["channel"], r["i"], None if np.isnan(r["value"]) else r["value"]) for r in back.collect())
    assert got == sorted((r["signal_id"], r["channel"], r["i"], r["value"]) for r in df.collect())
    assert back.filter("channel = 3 AND i > 30").count() == 18
    slices.write_slices(sorted_.filter("channel = 0"), str(tmp_path / "out"), 100.0, "overwrite")
    assert slices.read_slices(spark, str(tmp_path / "out")).count() == 80


def test_nothing(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert slices.read_slices(spark, str(tmp_path / "empty")).count() == 0
    slices.write_slices(spark.createDataFrame([], "signal_id string, channel int, i long, value double"), str(tmp_path / "out"))
    assert slices.read_slices(spark, str(tmp_path / "out")).count() == 0
    with pytest.raises(Exception, match="missing"):
        slices.read_slices(spark, str(tmp_path / "missing.wav")).count()
