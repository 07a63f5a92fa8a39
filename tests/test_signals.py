"""Operators, functions, plans and sources on Spark."""

import struct
import wave

import numpy as np
import pytest

from tremolith.errors import InvalidConfig, UnknownOperator, UnsupportedFormat
from tremolith.functions import envelope, metrics, preprocess, scoring
from tremolith.kernels import run
from tremolith.model import SIGNALS, derived, select_channels, to_array, to_long
from tremolith.operators import NATIVE, denoise, fan_out
from tremolith.plans import catalog, cli, config, pipeline, report
from tremolith.sources import readers, simulate

RNG = np.random.default_rng(7)


@pytest.fixture(scope="module")
def signals(spark):
    rows = [(f"s{k}", c, f"ch_{c}", 1.0, "", None, {}, RNG.normal(size=50 + k).tolist()) for k in range(3) for c in range(2)]
    return spark.createDataFrame(rows, SIGNALS)


def held(df, column="samples"):
    return {(r["signal_id"], r["channel"]): np.array(r[column]) for r in df.collect()}


def test_forms_round_trip(signals):
    back = held(to_array(to_long(signals).repartition(3)))
    assert all(np.array_equal(v, back[k]) for k, v in held(signals).items())
    assert select_channels(signals, 1).count() == 3
    assert {r["n_channels"] for r in derived(signals).collect()} == {2}


@pytest.mark.parametrize("name", sorted(NATIVE))
def test_native_equals_kernel(signals, name):
    found = held(to_array(NATIVE[name](to_long(signals))))
    for key, x in held(signals).items():
        assert found[key] == pytest.approx(run(name, x, 1.0), abs=1e-9), key


def test_even_windows_and_operations(signals):
    for params in ({"window_size": 4}, {"window_size": 4, "weight_type": "hamming"}):
        name = "moving_average_filter" if len(params) == 1 else "weighted_moving_average"
        found = held(to_array(NATIVE[name](to_long(signals), **params)))
        assert all(found[k] == pytest.approx(run(name, x, 1.0, params), abs=1e-9) for k, x in held(signals).items())
    found = held(to_array(NATIVE["morphological_filter"](to_long(signals), operation="occo")))
    assert all(found[k] == pytest.approx(run("morphological_filter", x, 1.0, {"operation": "occo"})) for k, x in held(signals).items())


def test_failures_are_rows(signals):
    rows = fan_out(signals, [("low_pass_butterworth", {}), ("ewma_base", {"alpha": 0.5})]).collect()
    bad = [r for r in rows if not r["success"]]
    assert len(rows) == 12 and len(bad) == 6 and all("Nyquist" in r["error_message"] for r in bad)
    with pytest.raises(UnknownOperator):
        fan_out(signals, [("no_such", {})])


def test_channels_mix_by_signal(signals):
    found = held(denoise(signals, "pca_denoise", {"n_components": 1}), "denoised")
    x = held(signals)
    both = run("pca_denoise", np.stack([x["s0", 0], x["s0", 1]]), 1.0, {"n_components": 1})
    assert found["s0", 1] == pytest.approx(both[1])


def test_empty_signals_do_not_fail(spark):
    df = spark.createDataFrame([("e", 0, "ch_0", 1.0, "", None, {}, [])], SIGNALS)
    assert not fan_out(df, [("kalman_filter", {})]).first()["success"]
    assert to_long(df).count() == 0
    assert preprocess.preprocess(df, unit=True).first()["samples"] == []


def test_preprocessing(signals):
    x = held(signals)
    done = held(preprocess.preprocess(signals, unit=True))
    assert all(done[k] == pytest.approx((v - v.mean()) / v.std()) for k, v in x.items())
    cut = preprocess.segments(signals, 16, 0.5).filter("signal_id = 's0' AND channel = 0").orderBy("segment_id").collect()
    assert [c["samples"] for c in cut] == [x["s0", 0][a : a + 16].tolist() for a in range(0, 35, 8)]
    with pytest.raises(ValueError):
        preprocess.segments(signals, 16, 1.0)
    assert {len(r["samples"]) for r in preprocess.resample(signals, 0.5).collect()} == {25, 26}


def test_envelope_peaks_at_the_fault_frequency(spark):
    made = simulate.gear_fault(spark, 12000.0, 1.0, 1000.0, 78.5, 0.5, noise_level=0.05)
    one = simulate.as_signal(made, "b", 12000.0)
    result = fan_out(preprocess.preprocess(one), [("moving_average_filter", {"window_size": 1})])
    spectra = envelope.spectrum_rows(envelope.envelopes(result))
    targets = envelope.fault_targets(spark, manual={"bpfo": 78.5, "gmf": 0.0})
    assert targets.count() == 1
    assert envelope.fault_matches(spectra, targets).first()["amplitude"] > 0
    peaks = envelope.dominant_peaks(spectra).orderBy("rank").collect()
    assert abs(peaks[0]["f"] - 78.5) < 1.5
    assert {r["i"] for r in simulate.bearing_fault(spark, 100.0, 1.0).collect()} == set(range(100))
    auto = {r["name"]: r["freq"] for r in envelope.fault_targets(spark, shaft_hz=25.0, bearing="6205").collect()}
    assert auto["bpfo"] == pytest.approx(9 * 25 / 2 * (1 - 7.94 / 39.04)) and auto["fr"] == 25.0


def test_plateaus_count_once(spark):
    s = [0.0, 1.0, 5.0, 5.0, 1.0, 0.0, 0.0, 4.0, 0.0, 0.0] + [0.0] * 10
    rows = [("x", 0, "a", k, k / 20, v) for k, v in enumerate(s)]
    df = spark.createDataFrame(rows, "signal_id string, channel int, algorithm_id string, k int, f double, s double")
    assert [(r["f"], r["a"]) for r in envelope.dominant_peaks(df).orderBy("rank").collect()] == [(0.1, 5.0), (0.35, 4.0)]


def test_metrics_against_numpy(spark):
    x = RNG.normal(size=400) + 5
    rows = [("s", 0, "a", i, float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "signal_id string, channel int, algorithm_id string, i long, value double")
    got = {r["metric"]: r["value"] for r in metrics.time_metrics(df).collect()}
    z = (x - x.mean()) / x.std()
    assert got["kurtosis"] == pytest.approx(np.mean(z**4)) and got["skewness"] == pytest.approx(abs(np.mean(z**3)))
    assert got["cf"] == pytest.approx(np.abs(x).max() / np.sqrt(np.mean(x * x))) and got["if"] == pytest.approx(np.abs(x).max() / np.abs(x).mean())
    full = {r["metric"]: r["value"] for r in metrics.complete(metrics.time_metrics(df), df).collect()}
    assert len(full) == 20 and full["ese"] == float("inf") and full["fbr"] == 1.0 and full["ffa"] == 0.0


def scored(spark):
    rows = [("s", 0, a, m, v, h) for m, h, vs in (("up", True, (1.0, 3.0, 2.0)), ("down", False, (1.0, 2.0, 3.0))) for a, v in zip("abc", vs, strict=True)]
    return spark.createDataFrame(rows, "signal_id string, channel int, algorithm_id string, metric string, value double, higher_is_better boolean")


def test_scores_by_hand(spark):
    m = scored(spark)
    of = lambda *a, **k: {r["algorithm_id"]: r["score"] for r in scoring.scores(m, *a, **k).collect()}
    equal = {"up": 0.5, "down": 0.5}
    assert of("weighted_sum", "minmax", equal) == pytest.approx({"a": 0.5, "b": 0.75, "c": 0.25})
    assert of("weighted_sum", "rank", equal) == pytest.approx({"a": 0.5, "b": 0.25, "c": 0.75})  # the best gets 0
    assert of("weighted_sum", "rank_desc", equal) == pytest.approx({"a": 0.5, "b": 0.75, "c": 0.25})
    assert of("borda_count") == pytest.approx({"a": 4 / 6, "b": 5 / 6, "c": 3 / 6})
    assert of("pareto") == pytest.approx({"a": 1.0, "b": 1.0, "c": 0.0})
    assert 0 < of("topsis")["b"] < 1
    with pytest.raises(ValueError):
        scoring.scores(m, "best_guess")
    failed = m.filter("algorithm_id = 'b'")
    ranks = {r["algorithm_id"]: r["overall_rank"] for r in scoring.rankings(m, scoring.scores(m, "borda_count"), failed).collect()}
    assert ranks == {"a": 1, "c": 2, "b": 3}


def test_constant_metrics_score_half(spark):
    m = scored(spark).selectExpr("signal_id", "channel", "algorithm_id", "metric", "1.0D AS value", "higher_is_better")
    assert {r["norm"] for r in scoring.normalised(m).collect()} == {0.5}


def test_simulated_pipeline_ranks(spark):
    over = {"simulation": {"sample_rate": 2400.0, "duration": 0.5}, "operators": {"mode": "category", "categories": ["time"]}, "metrics": {"enabled": ["ffr", "lsnr", "esk", "kurtosis", "sk"]}}
    found = pipeline.run(spark, config.load(overrides=over, environ={}))
    rows = found.rankings.collect()
    assert sorted(r["overall_rank"] for r in rows) == list(range(1, 8)) and all(0 <= r["overall_score"] <= 1 for r in rows)
    assert found.top().count() == 3 and found.top_signals().count() == 3
    text = report.markdown(found.rankings)
    assert text.startswith("# ") and text.count("\n") >= 11 and "<table>" in report.html(found.rankings)
    assert pipeline.category_summary(found.rankings, catalog.catalog(spark)).count() == 2
    assert report.metric_table(found.metrics).count() == 7
    found.denoised.unpersist()


def test_catalog_filters(spark):
    all_ = catalog.catalog(spark)
    assert catalog.filtered(all_, "classical").count() == 7
    assert catalog.filtered(all_, ["WAVELET", "svd"]).count() == 10
    assert catalog.filtered(all_, complexity="low", tags=["realtime"]).count() > 0
    assert catalog.search(all_, "KALMAN").count() == 2
    with pytest.raises(UnknownOperator):
        catalog.filtered(all_, "culinary")
    assert len(catalog.select_ids()) == 91


def test_config_precedence(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("scoring: {method: topsis}\noutput: {top_n: 5}\n")
    got = config.load(str(path), {"output": {"top_n": 7}}, {"TREMOLITH_SCORING__METHOD": "pareto", "TREMOLITH_OUTPUT__TOP_N": "4"})
    assert got["scoring"]["method"] == "topsis" and got["output"]["top_n"] == 7
    for bad in ({"scoring": {"method": "x"}}, {"operators": {"mode": "selected"}}, {"preprocess": {"overlap": 1.0}}):
        with pytest.raises(InvalidConfig):
            config.load(overrides=bad, environ={})
    assert cli.main(["init", str(tmp_path / "d.yaml")]) == 0 and (tmp_path / "d.yaml").exists()


def test_files(spark, tmp_path):
    x = (np.sin(np.arange(100) / 5) * 20000).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.stack([x, x // 2], 1).tobytes())
    got = readers.read_signals(spark, str(tmp_path / "a.wav")).orderBy("channel").collect()
    assert [r["sample_rate"] for r in got] == [8000.0] * 2 and got[0]["samples"] == pytest.approx(x / 32768)
    (tmp_path / "b.csv").write_text("left,right\n1,2\n3,4\n")
    got = readers.read_signals(spark, str(tmp_path / "b.csv"), channel=1, sample_rate=50.0).collect()
    assert [(r["channel_name"], r["samples"], r["sample_rate"]) for r in got] == [("right", [2.0, 4.0], 50.0)]
    with pytest.raises(UnsupportedFormat):
        readers.read_signals(spark, str(tmp_path / "c.docx"))
    uff = ["    -1", "    58", *["x"] * 6, "         2         4         1  0.0  0.25 0.0", *["x"] * 4, " 1.0 2.0", " 3.0 4.0", "    -1"]
    data, _, rate, _ = readers.parse_uff("\n".join(uff).encode())
    assert data.tolist() == [[1, 2, 3, 4]] and rate == 4.0


def test_mat_level_5():
    def element(kind, body):
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    def matrix(name, a):
        body = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", *a.shape)) + element(1, name.encode()) + element(9, a.tobytes("F"))
        return element(14, body)

    x = np.arange(20.0).reshape(10, 2)
    raw = b" " * 124 + b"\0\x01IM" + matrix("fs", np.array([[100.0]])) + matrix("x", x)
    data, _, rate, _ = readers.parse_mat(raw)
    assert np.array_equal(data, x.T) and rate == 100.0


def test_kernel_queries_hold_one_python_worker_a_task(spark, tmp_path):
    """Centring runs where the kernel runs, not in a worker of its own."""
    from tremolith.kernels import run
    from tremolith.queries import QUERIES

    rows = [(e, e * 7 % 4, e * 1_000, float(e * e % 17)) for e in range(160)]
    spark.createDataFrame(rows, "event_id long, user_id long, us long, value double").selectExpr("event_id", "user_id", "timestamp_micros(us) AS ts", "value").write.parquet(f"{tmp_path}/events.parquet")
    for name in ("vmd_denoise", "jade_denoise"):
        found = QUERIES[f"denoise_{name}"](spark, str(tmp_path))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" not in plan
        got = {}
        for r in sorted(found.collect(), key=lambda r: r["i"]):
            got.setdefault(r["signal_id"], []).append(r["value"])
        for user in range(4):
            x = np.array([v for e, u, _, v in rows if u == user])
            assert got[str(user)] == pytest.approx(run(name, x - x.mean(), 1.0), abs=2e-6)


def test_envelopes_take_few_rows_at_once(monkeypatch):
    import pyarrow as pa

    from tremolith.functions import envelope

    class Frame:
        columns = ["sample_rate", "denoised"]

        def select(self, *_):
            return self

        schema = None

        def mapInArrow(self, work, schema):
            return work

    monkeypatch.setattr(envelope.F, "lit", lambda v: type("C", (), {"cast": lambda self, t: self, "alias": lambda self, n: self})())
    batch = pa.RecordBatch.from_arrays([pa.array([1.0] * 1000), pa.array([[float(i % 7), 1.0, 2.0, -1.0] for i in range(1000)])], names=["sample_rate", "denoised"])
    sizes = [b.num_rows for b in envelope.envelopes(Frame())(iter([batch]))]
    assert sum(sizes) == 1000 and max(sizes) <= 256


FAILING = "alif basis_pursuit ceemd ceemdan eemd fractal iceemdan jade ksvd lmd vmd".split()


@pytest.mark.parametrize("name", [*(f"{n}_denoise" for n in FAILING), "cyclostationary_analysis"])
def test_failures_are_no_results(name, monkeypatch):
    """A signal on which a kernel fails has no samples that could pass for denoised ones."""
    import importlib

    import pyarrow as pa

    module = importlib.import_module("tremolith.operators.denoise")
    kernel = module.run
    monkeypatch.setattr(module, "run", lambda i, x, *a: (_ for _ in ()).throw(MemoryError("no room")) if x[0] > 5 else kernel(i, x, *a))
    good, bad = np.sin(np.arange(40.0)).tolist(), [9.0, 1.0, 2.0]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["g", "b"]), pa.array([0, 0], pa.int32()), pa.array([1.0, 1.0]), pa.array([good, bad]), pa.array([name] * 2), pa.array([[], []], pa.map_(pa.string(), pa.string()))],
        names=["signal_id", "channel", "sample_rate", "samples", "algorithm_id", "params"],
    )
    rows = [r for b in module._work(iter([batch])) for r in b.to_pylist()]
    assert [r["success"] for r in rows] == [True, False] and rows[1]["error_message"] == "MemoryError: no room"
    assert rows[1]["denoised"] == [None] * 3
    assert rows[0]["denoised"] == pytest.approx(run(name, np.array(good), 1.0))


def test_failed_signals_are_null_in_queries(spark, tmp_path):
    """One sample, or a missing value: no operator that fails there returns its input."""
    from tremolith.queries import QUERIES

    rows = [(e, 0, e * 1_000, float(e * e % 17)) for e in range(40)] + [(100, 1, 0, 7.5)] + [(200 + e, 2, e * 1_000, float(e % 5) if e != 3 else None) for e in range(40)]
    spark.createDataFrame(rows, "event_id long, user_id long, us long, value double").selectExpr("event_id", "user_id", "timestamp_micros(us) AS ts", "value").write.parquet(f"{tmp_path}/events.parquet")
    for name, failing in (("jade_denoise", ("1", "2")), ("cyclostationary_analysis", ("1",)), ("ksvd_denoise", ("2",))):
        got = {}
        for r in QUERIES[f"denoise_{name}"](spark, str(tmp_path)).collect():
            got.setdefault(r["signal_id"], []).append(r["value"])
        assert {k: len(v) for k, v in got.items()} == {"0": 40, "1": 1, "2": 40}
        assert all(v is not None for v in got["0"])
        for user in failing:
            assert set(got[user]) == {None}, (name, user)


def test_failed_operators_rank_last_without_a_score(signals):
    """A failure has no metrics: those of the others are normalised without it."""

    def ranked(*ids):
        chosen = config.merge(config.DEFAULTS, {"operators": {"mode": "selected", "ids": list(ids)}, "envelope": {"manual": {"bpfo": 0.1}}, "metrics": {"enabled": ["kurtosis", "cf", "esk"]}})
        found = pipeline.analyse(signals, chosen)
        rows = {(r["signal_id"], r["channel"], r["algorithm_id"]): (r["overall_score"], r["overall_rank"]) for r in found.rankings.collect()}
        found.release()
        return rows

    two = ranked("ewma_base", "median_filter")
    three = ranked("ewma_base", "median_filter", "low_pass_butterworth")
    assert len(three) == 18 and {k: three[k] for k in two} == two
    assert {v for k, v in three.items() if k not in two} == {(None, 3)}
