"""Predictors and long spectra against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolith.functions import design, long_fft
from tremolith.kernels import dsp, run

RNG = np.random.default_rng(71)
SIGNALS = {("a", 0): np.cumsum(RNG.normal(size=210)), ("a", 1): RNG.normal(size=97), ("b", 0): RNG.normal(size=4), ("c", 0): np.array([3.0]), ("d", 0): np.zeros(20)}
LONG = "signal_id string, channel int, i long, value double"


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(s, c, i, float(v)) for (s, c), x in SIGNALS.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, LONG).repartition(5)


def held(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["signal_id"], r["channel"]), {})[r["i"]] = r["value"]
    return {k: np.array([x[i] for i in range(len(x))]) for k, x in out.items()}


@pytest.mark.parametrize("order", [1, 3, 8])
@pytest.mark.parametrize("part", [16, 1000])
def test_weights_are_those_of_the_normal_equations(samples, order, part):
    for method in design.METHODS:
        got = {(r["signal_id"], r["channel"]): np.array(r["weights"]) for r in design.predictors(samples, order, method, part).collect()}
        assert got.keys() == SIGNALS.keys()
        for k, x in SIGNALS.items():
            m = min(order, len(x) - 1)
            assert len(got[k]) == m
            if not m:
                continue
            if method == "covariance":
                rows = np.array([[x[i - 1 - j] for j in range(m)] for i in range(m, len(x))])
                want = np.linalg.lstsq(rows, x[m:], rcond=None)[0]
                if len(rows) < m:
                    continue  # many solutions
            else:
                r = np.array([x[: len(x) - j] @ x[j:] for j in range(m + 1)])
                want = np.linalg.lstsq(r[np.abs(np.subtract.outer(np.arange(m), np.arange(m)))], r[1:], rcond=None)[0]
            assert got[k] == pytest.approx(want, rel=1e-6, abs=1e-8), (method, k)


@pytest.mark.parametrize("part", [16, 1000])
def test_wiener_equals_the_kernel(samples, part):
    got = held(design.wiener(samples.filter("signal_id != 'c'"), 8, part=part))
    for k, x in SIGNALS.items():
        if k[0] != "c":
            assert got[k] == pytest.approx(run("wiener_filter", x, 1.0, {"filter_order": 8}), abs=1e-7), k


def test_nulls_are_zeros_and_nothing(samples):
    some = samples.filter("signal_id = 'a'").withColumn("value", F.when(F.col("i") % 5 != 0, F.col("value")))
    zero = some.withColumn("value", F.coalesce("value", F.lit(0.0)))
    assert all(v == pytest.approx(held(design.wiener(zero, 3))[k]) for k, v in held(design.wiener(some, 3)).items())
    assert design.wiener(samples.limit(0), 3).count() == 0
    assert long_fft.spectrum(samples.limit(0)).count() == 0
    with pytest.raises(ValueError):
        design.predictors(samples, 3, "other")


def test_rows_for():
    assert [long_fft.rows_for(n) for n in (1, 2, 7, 12, 36, 10**6, 97 * 89)] == [1, 1, 1, 3, 6, 1000, 89]


def spectra(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["signal_id"], r["channel"]), {})[r["k"]] = (r["f"], r["s"])
    return {k: np.array([x[i] for i in range(len(x))]) for k, x in out.items()}


@pytest.mark.parametrize(("block", "longest"), [(1 << 20, 1 << 22), (20, 1 << 22), (64, 16)])
def test_spectrum_equals_rfft(samples, monkeypatch, block, longest):
    """Also in small blocks, and by the chirp where rows would be too long."""
    monkeypatch.setattr(long_fft, "BLOCK", block)
    monkeypatch.setattr(long_fft, "LONGEST", longest)
    given = samples if longest > 16 else samples.filter("signal_id != 'd'")
    for k, got in spectra(long_fft.spectrum(given, 50.0)).items():
        x = SIGNALS[k]
        assert got[:, 1] == pytest.approx(np.abs(np.fft.rfft(x)), abs=1e-8 * max(1, np.abs(x).sum())), k
        assert got[:, 0] == pytest.approx(np.fft.rfftfreq(len(x), 1 / 50))


def test_inverse_and_envelope(samples):
    some = samples.filter("signal_id IN ('a', 'b')")
    back = long_fft.inverse(long_fft.transformed(long_fft.complex_frame(some))).withColumn("value", F.col("re"))
    for k, x in held(back).items():
        assert x == pytest.approx(SIGNALS[k], abs=1e-9)
    for k, x in held(long_fft.envelope(some)).items():
        assert x == pytest.approx(np.abs(dsp.hilbert(SIGNALS[k])), abs=1e-9)
    for k, got in spectra(long_fft.envelope_spectrum(some)).items():
        e = np.abs(dsp.hilbert(SIGNALS[k]))
        assert got[:, 1] == pytest.approx(np.abs(np.fft.rfft(e - e.mean())), abs=1e-8)


def test_a_million_samples(spark):
    n = 1_000_000
    one = spark.range(n).select(F.lit("all").alias("signal_id"), F.lit(0).alias("channel"), F.col("id").alias("i"), (F.sin(F.col("id") * 0.3) + (F.col("id") * 7919 % 1013) / 1013).alias("value"))
    i = np.arange(n)
    want = np.abs(np.fft.rfft(np.sin(i * 0.3) + (i * 7919 % 1013) / 1013))
    got = long_fft.spectrum(one).filter("k % 997 = 0").select("k", "s").collect()
    assert len(got) == 502
    for r in got:
        assert r["s"] == pytest.approx(want[r["k"]], abs=1e-6)
