"""Streams give what the batch kernels give."""

import datetime as dt

import numpy as np
import pytest

from tremolith.kernels import run
from tremolith.streaming import denoise_stream, window_levels

X = np.random.default_rng(3).normal(size=60)
SCHEMA = "signal_id string, ts timestamp, value double"


def stream(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    for part in range(3):
        rows = [("s", start + dt.timedelta(seconds=i), float(X[i])) for i in range(20 * part, 20 * part + 20)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))


@pytest.mark.parametrize("name,params", [("ewma_base", {"alpha": 0.4}), ("nlms_adaptive_filter", {"filter_order": 4})])
def test_causal_operators(spark, tmp_path, name, params):
    q = denoise_stream(stream(spark, tmp_path), name, params).writeStream.format("memory").queryName(f"out_{name}").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        got = [r["denoised"] for r in spark.table(f"out_{name}").orderBy("ts").collect()]
    finally:
        q.stop()
    assert got == pytest.approx(run(name, X, 1.0, params))


def test_windows(spark, tmp_path):
    q = window_levels(stream(spark, tmp_path), "10 seconds").writeStream.outputMode("complete").format("memory").queryName("levels").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        got = [r["rms"] for r in spark.table("levels").orderBy("start").collect()]
    finally:
        q.stop()
    assert got == pytest.approx([np.sqrt(np.mean(X[a : a + 10] ** 2)) for a in range(0, 60, 10)])
