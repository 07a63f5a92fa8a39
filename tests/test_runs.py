"""Throttle, run log and run history."""

import os

import pyarrow as pa
import pytest

from tremolith.errors import InvalidConfig
from tremolith.model import SIGNALS
from tremolith.operators import Throttle, fan_out, throttle
from tremolith.plans import history, report, runlog

RANKS = "signal_id string, channel int, algorithm_id string, overall_rank int, overall_score double"


@pytest.fixture(scope="module")
def signals(spark):
    return spark.createDataFrame([(f"s{k}", 0, "ch_0", 1.0, "", None, {}, [float(v) for v in range(5 + k)]) for k in range(4)], SIGNALS)


def test_a_stage_has_its_own_profile(spark, signals, monkeypatch):
    held = Throttle(task_cpus=2)
    assert held.profile(spark) is None  # local mode has none
    assert held.built().taskResources["cpus"].amount == 2.0
    monkeypatch.setattr(Throttle, "profile", lambda self, spark: self.built())
    plan = fan_out(signals, [("ewma_base", {})], throttle=held)._jdf.queryExecution().executedPlan().toString()
    bare = fan_out(signals, [("ewma_base", {})])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Profile" in plan and "Profile" not in bare


def test_results_are_the_same_under_a_throttle(signals):
    plan = [("ewma_base", {}), ("svd_denoise", {})]
    how = Throttle(priority="below_normal", cores=1, blas=1, task_cpus=3)
    key = lambda df: sorted((r["signal_id"], r["algorithm_id"], r["denoised"]) for r in df.collect())
    assert key(fan_out(signals, plan, throttle=how)) == key(fan_out(signals, plan))


def test_workers_are_limited_and_set_free(spark):
    def look(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"cores": [len(os.sched_getaffinity(0))] * b.num_rows, "threads": [int(os.environ.get("OMP_NUM_THREADS", 0))] * b.num_rows, "nice": [os.nice(0)] * b.num_rows})

    schema = "cores bigint, threads bigint, nice bigint"
    df = spark.range(4).coalesce(1)
    inside = throttle.map_batches(df, look, schema, Throttle("below_normal", 1, 3)).first()
    assert (inside["cores"], inside["threads"]) == (1, 3) and inside["nice"] >= 10
    assert throttle.map_batches(df, look, schema).first()["cores"] == len(os.sched_getaffinity(0))


def test_blas_threads_are_given_back():
    before = [get() for get, _ in throttle._openblas()]
    with throttle.blas_threads(1):
        assert {get() for get, _ in throttle._openblas()} <= {1}
    assert [get() for get, _ in throttle._openblas()] == before


def test_throttle_settings(spark):
    assert throttle.workers(spark, 2) == 2 and throttle.workers(spark) == spark.sparkContext.defaultParallelism
    for bad in ({"priority": "urgent"}, {"cores": -1}):
        with pytest.raises(InvalidConfig):
            Throttle(**bad)


def results(spark):
    rows = [("a", True, 1.0, 5), ("a", False, 3.0, None), ("b", None, None, 7), ("c", True, 0.5, -1), (None, True, 0.5, 2)]
    return spark.createDataFrame(rows, "algorithm_id string, success boolean, execution_time double, n int").repartition(3)


def test_log_of_the_job_itself(spark, tmp_path):
    expected = [runlog.Expectation("some", "n > 0"), runlog.Expectation("known", "algorithm_id IS NOT NULL", "drop")]
    out, log = runlog.logged(results(spark), ["a", "b", "none"], expected)
    out.write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    got = {r["algorithm_id"]: tuple(r)[1:] for r in log.rows(spark).collect()}
    assert got == {"a": (2, 1, 4.0, 3.0), "b": (1, 1, 0.0, 0.0), "other": (2, 0, 1.0, 0.5)}
    assert {r["expectation"]: r["rows"] for r in log.broken(spark).collect()} == {"some": 2, "known": 1}


def test_an_expectation_may_end_the_job(spark):
    out, _ = runlog.logged(results(spark), ["a"], [runlog.Expectation("some", "n > 0", "fail")])
    with pytest.raises(Exception, match="some"):
        out.count()
    with pytest.raises(InvalidConfig):
        runlog.Expectation("x", "true", "ignore")


def test_log_of_nothing(spark):
    out, log = runlog.logged(results(spark).limit(0), ["a"], [runlog.Expectation("some", "n > 0")])
    assert out.count() == 0 and log.rows(spark).count() == 0 and log.broken(spark).first()["rows"] == 0


def ranks(spark, rows):
    return spark.createDataFrame(rows, RANKS)


def test_changes_between_runs(spark, tmp_path):
    old = [("s", 0, "a", 1, 0.9), ("s", 0, "b", 2, 0.5), ("s", 0, "c", 3, None), ("t", None, "a", 1, 0.1), ("u", 0, "a", 1, 0.3), ("u", 0, "a", 1, 0.3), ("v", 0, "a", 4, 0.2)]
    new = [("s", 0, "a", 2, 0.4), ("s", 0, "b", 1, 0.5), ("s", 0, "c", 3, None), ("t", None, "a", 1, 0.2), ("u", 0, "a", 1, 0.3), ("w", 0, "a", 1, 0.7)]
    folder = str(tmp_path / "runs")
    history.save(ranks(spark, old), folder, "2024-02-29")
    history.save(ranks(spark, old[:1]), folder, "2024-03-01")
    history.save(ranks(spark, new), folder, "2024-03-01")  # replaces that date alone
    assert [(str(r["run_date"]), r["rows"], r["signals"]) for r in history.runs(spark, folder).collect()] == [("2024-03-01", 6, 4), ("2024-02-29", 7, 4)]
    a, b = (history.load(spark, folder, d) for d in ("2024-02-29", "2024-03-01"))
    assert "PartitionFilters: [isnotnull(run_date" in a._jdf.queryExecution().executedPlan().toString()
    got = {(r["signal_id"], r["algorithm_id"], r["change"], r["old_rank"], r["new_rank"], r["old_score"], r["new_score"]) for r in history.changes(a, b).collect()}
    assert got == {
        ("s", "a", "changed", 1, 2, 0.9, 0.4), ("s", "b", "changed", 2, 1, 0.5, 0.5), ("t", "a", "changed", 1, 1, 0.1, 0.2),
        ("u", "a", "removed", 1, None, 0.3, None), ("v", "a", "removed", 4, None, 0.2, None), ("w", "a", "added", None, 1, None, 0.7),
    }
    assert sorted((r["signal_id"], r["algorithm_id"]) for r in history.unchanged(a, b).collect()) == [("s", "c"), ("u", "a")]
    none = history.load(spark, folder, "2020-01-01")
    assert history.changes(none, none).count() == 0
    assert {r["change"] for r in history.changes(none, b).collect()} == {"added"} and history.changes(a, a).count() == 0


def test_reports_are_dated(spark):
    rows = spark.createDataFrame([("s", 0, "ewma_base", 1, 0.9, 0.1)], RANKS + ", execution_time double")
    assert "Written 2" in report.markdown(rows)


def test_inventory_of_stored_rows(spark):
    from tremolith.plans import catalog

    rows = [("a", 1, "s", 1.0), ("a", 1, "s", None), ("a", 2, "t", 3.0), (None, 1, "s", 5.0), ("b", 1, None, 2.0), ("b", 1, None, 2.0)]
    df = spark.createDataFrame(rows, "kind string, day int, signal_id string, value double")
    got = {(r["kind"], r["day"], r["level"]): tuple(r)[3:] for r in catalog.inventory(df, ["kind", "day"]).collect()}
    assert got == {
        ("a", 1, 2): (2, 1, 1, 1.0, 1.0), ("a", 2, 2): (1, 1, 0, 3.0, 3.0), (None, 1, 2): (1, 1, 0, 5.0, 5.0), ("b", 1, 2): (2, 0, 0, 2.0, 2.0),
        ("a", None, 1): (3, 2, 1, 1.0, 3.0), (None, None, 1): (1, 1, 0, 5.0, 5.0), ("b", None, 1): (2, 0, 0, 2.0, 2.0), (None, None, 0): (6, 2, 1, 1.0, 5.0),
    }
    assert all(r["samples"] == 0 for r in catalog.inventory(df.limit(0), ["kind"]).collect())
