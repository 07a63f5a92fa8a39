"""Streams whose result does not depend on their batches."""

import datetime as dt
import random

import numpy as np
import pytest

from tremolith.kernels import run
from tremolith.streaming import ordered

START = dt.datetime(2024, 1, 1)
SCHEMA = "signal_id string, ts timestamp, value double"


def rows():
    rng = random.Random(91)
    out = []
    for s, start in (("a", 0), ("b", 7)):
        for k in range(120):
            pause = 4000 * (k >= 50) + 9000 * (k >= 90)
            out.append((s, START + dt.timedelta(seconds=start + 10 * k + pause), round(rng.gauss(0, 1), 3)))
    out += [out[3], out[3], ("a", out[4][1], 9.0), ("a", None, 1.0), ("b", out[5][1], None)]  # repeated, tied, null
    return out


def fed(spark, folder, batches):
    """One file a batch, in this order; the last row moves the watermark past all."""
    batches = [*batches, [("end", START + dt.timedelta(days=9), 0.0)], [("end", START + dt.timedelta(days=99), 0.0)]]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def cuts(seed, late):
    """Batches of rows that come up to ``late`` seconds behind their time."""
    rng = random.Random(seed)
    timed = sorted(((r[1].timestamp() if r[1] else 0) + rng.random() * late, k) for k, r in enumerate(rows()))
    order, out = [rows()[k] for _, k in timed], []
    while order:
        n = rng.randrange(20, 90)
        out, order = [*out, order[:n]], order[n:]
    return out


def sessions(signal, gap):
    own = sorted((r[1], r[2]) for r in rows() if r[0] == signal and r[1] and r[2] is not None)
    found = [[own[0]]]
    for a, b in zip(own, own[1:]):
        if (b[0] - a[0]).total_seconds() > gap:
            found.append([])
        found[-1].append(b)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_whatever_the_batches(spark, tmp_path, seed):
    stream = fed(spark, tmp_path, cuts(seed, 500))
    found = ordered.drained(ordered.denoise_ordered(stream, "ewma_base", {"alpha": 0.4}, "10 minutes", "30 minutes"), str(tmp_path / "out"), str(tmp_path / "c"))
    got = {}
    for r in found.filter("signal_id != 'end'").collect():
        got.setdefault((r["signal_id"], r["session"]), []).append((r["ts"], r["value"], r["denoised"]))
    want = {(s, own[0][0]): own for s in "ab" for own in sessions(s, 1800)}
    assert got.keys() == want.keys() and len(want) == 6
    for k, own in want.items():
        y = run("ewma_base", np.array([v for _, v in own]), 1.0, {"alpha": 0.4}).tolist()
        mine, theirs = sorted(got[k]), sorted((*o, d) for o, d in zip(own, y, strict=True))  # equal rows by their results
        assert [m[:2] for m in mine] == own
        assert [m[2] for m in mine] == pytest.approx([m[2] for m in theirs]), k


def test_late_rows_are_dropped(spark, tmp_path):
    early = [("a", START + dt.timedelta(seconds=k), 1.0) for k in range(5)]
    stream = fed(spark, tmp_path, [[("a", START + dt.timedelta(hours=5), 2.0)], [("a", START + dt.timedelta(hours=6), 2.0)], early])
    found = ordered.drained(ordered.denoise_ordered(stream, "ewma_base", {}, "10 minutes", "1 day"), str(tmp_path / "out"), str(tmp_path / "c"))
    assert found.filter("signal_id = 'a'").count() == 2


def test_session_levels(spark, tmp_path):
    found = ordered.drained(ordered.session_levels(fed(spark, tmp_path, cuts(3, 500)), "10 minutes", "30 minutes"), str(tmp_path / "out"), str(tmp_path / "c"))
    got = {(r["signal_id"], r["start"]): (r["n"], r["peak"]) for r in found.filter("signal_id != 'end'").collect()}
    assert got == {(s, own[0][0]): (len(own), max(abs(v) for _, v in own)) for s in "ab" for own in sessions(s, 1800)}


def test_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    assert ordered.drained(ordered.denoise_ordered(stream, "ewma_base"), str(tmp_path / "out"), str(tmp_path / "c")).count() == 0
