"""Moments and metrics against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolith.functions import metrics, moments
from tremolith.operators.denoise import RESULT

RNG = np.random.default_rng(51)


def plain(x):
    x = np.asarray([v for v in x if v is not None], float)
    if not len(x):
        return {"kurtosis": 0.0, "skewness": 0.0, "cf": 1.0, "if": 0.0}
    c = x - x.mean()
    var, rms, mean = (c**2).mean(), math.sqrt((x**2).mean()), np.abs(x).mean()
    return {
        "kurtosis": (c**4).mean() / var**2 if var > 1e-24 else 0.0, "skewness": abs((c**3).mean() / var**1.5) if var > 1e-24 else 0.0,
        "cf": np.abs(x).max() / rms if rms else 1.0, "if": np.abs(x).max() / mean if mean else 0.0,
    }


SIGNALS = {
    ("a", 0): (1e6 + RNG.normal(size=200)).tolist(), ("a", 1): RNG.exponential(size=77).tolist() + [None] * 3, ("b", 0): [2.0] * 9, ("b", 1): [None, None],
    ("c", 0): [0.0, 0.0], ("d", 3): [5.0], ("e", None): [1.0, 2.0, 4.0], ("e", 1): [1.0, 1.0],
}


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(s, c, v, k % 4) for (s, c), x in SIGNALS.items() for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "signal_id string, channel int, value double, part int").repartition(5)


def held(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["signal_id"], r["channel"]), {})[r["metric"]] = r["value"]
    return out


def expected():
    want = {k: plain(x) for k, x in SIGNALS.items()}
    return want | {(s, -1): plain([v for (t, _), x in SIGNALS.items() if t == s for v in x]) for s, _ in SIGNALS}


def test_channels_and_flattened(samples):
    found = moments.moments(samples, ["signal_id"], flattened=True)
    got, want = held(moments.time_metrics(found, ["signal_id", "channel"])), expected()
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-6), k


def test_one_shuffle_for_both(samples):
    plan = moments.moments(samples, ["signal_id"], flattened=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("fan_in", [2, 3, 64])
def test_merged_equals_direct(samples, fan_in):
    parts = moments.moments(samples, ["signal_id", "part"])
    whole = moments.merged(parts, ["signal_id"], fan_in).withColumn("channel", F.lit(-1))
    got = held(moments.time_metrics(whole, ["signal_id", "channel"]))
    want = {k: v for k, v in expected().items() if k[1] == -1}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-5), k
    again = moments.merged(moments.merged(parts, ["signal_id", "part"]), ["signal_id"]).orderBy("signal_id").collect()
    direct = moments.merged(parts, ["signal_id"]).orderBy("signal_id").collect()
    assert [r["n"] for r in again] == [r["n"] for r in direct] and [r["m4"] for r in again] == pytest.approx([r["m4"] for r in direct])


def test_nothing(samples):
    none = samples.limit(0)
    assert moments.moments(none, ["signal_id"], flattened=True).count() == 0
    assert moments.merged(moments.moments(none, ["signal_id"]), ["signal_id"]).count() == 0


def test_rows_of_the_pipeline(spark):
    rows = [("s", c, 1.0, "raw", {}, RNG.normal(size=20 + c).tolist(), 0.0, True, None) for c in (0, 1)]
    found = metrics.flattened_metrics(spark.createDataFrame(rows, RESULT), ["kurtosis", "cf", "gi"]).collect()
    want = plain(rows[0][5] + rows[1][5])
    assert {r["metric"]: r["value"] for r in found} == pytest.approx({k: want[k] for k in ("kurtosis", "cf")})
    assert {r["channel"] for r in found} == {-1}
