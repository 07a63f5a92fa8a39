"""Signals cut into parts: the same results as windows over whole channels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremolith.model import KEYS, to_array, to_long
from tremolith.functions import preprocess
from tremolith.operators import NATIVE, long

RNG = np.random.default_rng(31)
LONG = "signal_id string, channel int, i long, value double"


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(f"s{s}", c, i, float(v)) for s, n in enumerate((1, 20, 15, 300, 97)) for c in range(2) for i, v in enumerate(RNG.normal(size=n))]
    return spark.createDataFrame(rows, LONG).repartition(7)


def held(df):
    return {(r["signal_id"], r["channel"], r["i"]): r["value"] for r in df.collect()}


CASES = [(name, {}) for name in sorted(NATIVE) if name != "gaussian_filter"] + [
    ("moving_average_filter", {"window_size": 40}), ("weighted_moving_average", {"window_size": 4}), ("median_filter", {"kernel_size": 33}),
    ("morphological_filter", {"operation": "occo", "window_size": 9}), ("savitzky_golay_filter", {"window_length": 9, "polyorder": 2}), ("ewma_base", {"alpha": 0.05}),
]


@pytest.mark.parametrize(("name", "params", "part"), [(*c, 16) for c in CASES] + [("median_filter", {}, 1000), ("kalman_filter", {}, 1000)])
def test_equals_the_whole_window(samples, name, params, part):
    given = samples.filter("signal_id != 's0' AND signal_id != 's2'") if name == "savitzky_golay_filter" else samples
    want, got = held(NATIVE[name](given, **params)), held(long.filtered(given, name, part, **params))
    assert got.keys() == want.keys()
    assert [got[k] for k in want] == pytest.approx(list(want.values()), abs=1e-9)


def test_mirrored_ends(samples):
    given = samples.filter("signal_id IN ('s1', 's3', 's4')")
    want = held(NATIVE["gaussian_filter"](given))
    assert held(long.filtered(given, "gaussian_filter", 16)) == pytest.approx(want)


def test_whole_channel_numbers(samples):
    assert held(long.centred(samples)) == pytest.approx(held(preprocess.remove_dc(samples)), abs=1e-12)
    assert held(long.scaled(samples)) == pytest.approx(held(preprocess.normalise(samples)), abs=1e-12)


@pytest.mark.parametrize("name", ["moving_average_filter", "median_filter", "morphological_filter"])
def test_nulls(samples, name):
    given = samples.withColumn("value", F.when(F.col("i") % 5 != 2, F.col("value")))
    assert held(long.filtered(given, name, 16)) == pytest.approx(held(NATIVE[name](given)))


def test_nulls_go_on_as_nan_in_scans(samples):
    given = samples.filter("signal_id = 's3'").withColumn("value", F.when(F.col("i") != 40, F.col("value")))
    for k, v in held(long.filtered(given, "ewma_base", 16)).items():
        assert np.isnan(v) == (k[2] >= 40)


def test_empty_table_and_no_reach(samples):
    for name in NATIVE:
        assert long.filtered(samples.limit(0), name, 16).count() == 0
    with pytest.raises(KeyError):
        long.reach("emd_standard", {})


def test_halo_rows_are_edge_rows_only(samples):
    parts = long.in_parts(samples.filter("signal_id = 's3'"), 3, 2, 100)
    sizes = {r["signal_id"]["part"]: r["n"] for r in parts.filter("channel = 0").groupBy("signal_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Part 3 has only rows that part 2's last rows reach; it owns none.
    assert sizes == {0: 102, 1: 105, 2: 103, 3: 3}
    assert long.own_rows(parts, 100).count() == 600


def test_a_long_signal_lies_over_many_tasks(spark):
    n = 200_000
    one = spark.range(n).select(F.lit("all").alias("signal_id"), F.lit(0).alias("channel"), F.col("id").alias("i"), F.sin("id").alias("value"))
    parts = long.in_parts(one, 2, 2, 10_000).groupBy("signal_id", *KEYS[1:]).agg(F.count(F.lit(1)).alias("n"))
    assert parts.filter("n > 2").count() == n // 10_000 and parts.agg(F.max("n")).first()[0] == 10_004
    got = long.filtered(one, "kalman_filter", 10_000)
    x = np.sin(np.arange(n))
    rule = long.SCANS["kalman_filter"]()
    want = rule.run(x, 0, np.array(rule.first(x[0])))[0]
    for r in got.filter("i % 9973 = 0 OR i = 199999").collect():
        assert r["value"] == pytest.approx(want[r["i"]], abs=1e-9)


def test_numbering(spark):
    rows = [(k, v, j) for j, (k, v) in enumerate([(None, 1.0)] * 3 + [("a", None)] * 2 + [("a", float(v)) for v in RNG.integers(0, 40, 500)] + [("b", 0.5)])]
    df = spark.createDataFrame(rows, "k string, v double, j int").repartition(5)
    got = long.numbered(df, ("k",), ("v", "j")).collect()
    for key in (None, "a", "b"):
        own = sorted((r for r in got if r["k"] == key), key=lambda r: r["i"])
        assert [r["i"] for r in own] == list(range(len(own)))
        assert [(r["v"], r["j"]) for r in own] == sorted(((v, j) for k, v, j in rows if k == key), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    ties = long.numbered(df, ("k",), ("v",)).collect()
    assert sorted((str(r["k"]), r["i"]) for r in ties) == sorted((str(r["k"]), r["i"]) for r in got)
    assert long.numbered(df.limit(0), ("k",), ("v",)).count() == 0


def test_forms_still_round_trip(samples):
    assert held(to_long(to_array(samples))) == held(samples)
