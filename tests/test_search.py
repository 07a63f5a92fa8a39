"""The parameter search against a plain one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolith.errors import InvalidConfig
from tremolith.kernels import get, run
from tremolith.plans import search

RNG = np.random.default_rng(61)
SIGNALS = {("a", 0): RNG.normal(size=300), ("a", 1): np.sin(np.arange(130) / 9) + RNG.normal(size=130) / 5, ("b", 0): RNG.normal(size=7), ("c", 0): np.ones(50)}


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(s, c, i, float(v)) for (s, c), x in SIGNALS.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "signal_id string, channel int, i long, value double").repartition(5)


def snr(operator_id, x, params, share=1.0):
    n = len(x) if share == 1 else min(len(x), max(math.ceil(len(x) * share), search.LEAST))
    y = run(operator_id, x[:n], 1.0, params)
    return 10 * math.log10(np.var(x[:n]) / (np.var(x[:n] - y) + 1e-10)) if np.var(x[:n]) else -math.inf


CASES = [
    ("moving_average_filter", '{"window_size": [2, 20]}', 5), ("median_filter", '{"kernel_size": [3, 9]}', 7), ("weighted_moving_average", '{"window_size": [1, 8]}', 4),
]


@pytest.mark.parametrize(("operator_id", "bounds", "steps"), CASES)
@pytest.mark.parametrize("part", [40, 10_000])
def test_exhaustive_equals_plain(spark, samples, operator_id, bounds, steps, part):
    tried = search.candidates(spark, operator_id, bounds, steps)
    got = {(r["signal_id"], r["channel"]): r for r in search.search(samples, operator_id, bounds, steps, part, exhaustive=True).collect()}
    assert got.keys() == SIGNALS.keys()
    for k, x in SIGNALS.items():
        want = [snr(operator_id, x, p) for p in tried]
        assert got[k]["snr"] == pytest.approx(max(want)) and got[k]["params"] == {n: float(v) for n, v in tried[int(np.argmax(want))].items()}


def test_halving_equals_plain_halving(spark, samples):
    bounds, steps = '{"window_size": [2, 28]}', 27
    tried = search.candidates(spark, "moving_average_filter", bounds, steps)
    got = {(r["signal_id"], r["channel"]): r for r in search.search(samples, "moving_average_filter", bounds, steps, 64).collect()}
    for k, x in SIGNALS.items():
        alive = list(range(len(tried)))
        for share, left in ((1 / 9, 9), (1 / 3, 3), (1.0, 1)):
            merit = {c: snr("moving_average_filter", x, tried[c], share) for c in alive}
            alive = sorted(alive, key=lambda c: (-merit[c], c))[:left]
        assert got[k]["params"]["window_size"] == tried[alive[0]]["window_size"] and got[k]["snr"] == pytest.approx(merit[alive[0]])


def test_halving_equals_exhaustive_on_a_small_grid(samples):
    how = ("weighted_moving_average", '{"window_size": [3, 11]}', 9)  # narrower is closer, on any share of the samples
    both = [{(r["signal_id"], r["channel"]): r["params"] for r in search.search(samples, *how, exhaustive=e, least=3).collect()} for e in (False, True)]
    assert both[0] == both[1]


def test_bounds(spark):
    assert [(r["name"], r["low"], r["high"]) for r in search.bounds_of(spark, '{"a": [1, 2.5]}').collect()] == [("a", 1.0, 2.5)]
    assert search.candidates(spark, "moving_average_filter", '{"window_size": [2, 4]}', 9) == [{"window_size": w} for w in (2, 3, 4)]
    assert isinstance(get("moving_average_filter").defaults["window_size"], int)
    for bad in ("no json", "{}", '{"other": [1, 2]}', '{"window_size": [3]}', '{"window_size": [4, 2]}'):
        with pytest.raises(InvalidConfig):
            search.candidates(spark, "moving_average_filter", bad)


def test_nulls_ties_and_nothing(samples):
    how = ("moving_average_filter", '{"window_size": [2, 5]}', 4)
    assert search.search(samples.limit(0), *how, exhaustive=True).count() == 0
    none = samples.filter("signal_id = 'b'").withColumn("value", F.lit(None).cast("double"))
    assert search.search(none, *how, exhaustive=True).count() == 0
    flat = samples.filter("signal_id = 'c'").withColumn("value", F.lit(0.0))
    assert search.search(flat, *how, exhaustive=True).first()["params"] == {"window_size": 2.0}
    some = samples.filter("signal_id = 'a'").withColumn("value", F.when(F.col("i") % 7 != 3, F.col("value")))
    assert search.search(some, *how, exhaustive=True).count() == 2
    with pytest.raises(InvalidConfig):
        search.search(samples, "emd_standard", '{"max_imfs": [1, 2]}')


def test_equal_windows_tie_however_sums_are_cut(spark):
    """An even kernel is the next odd one; a spilling aggregation adds up in other orders."""
    rows = [(str(s), 0, i, math.sin(i * (s + 1)) * 100 + math.cos(i * i)) for s in range(40) for i in range(60)]
    samples = spark.createDataFrame(rows, "signal_id string, channel int, i long, value double")
    name = "spark.sql.TungstenAggregate.testFallbackStartsAt"
    spark.conf.set(name, "37, 53")
    try:
        tried = search.candidates(spark, "median_filter", '{"kernel_size": [3, 11]}', 9)
        found = {(r["signal_id"], r["candidate"]): r["snr"] for r in search.judged(samples, "median_filter", tried).collect()}
        best = search.search(samples, "median_filter", '{"kernel_size": [3, 11]}', 9, exhaustive=True).collect()
    finally:
        spark.conf.unset(name)
    assert len(found) == 40 * 9
    assert all(found[str(s), k] == found[str(s), k + 1] for s in range(40) for k in (1, 3, 5, 7))
    assert {r["params"]["kernel_size"] for r in best} <= {3.0, 4.0, 6.0, 8.0, 10.0}
