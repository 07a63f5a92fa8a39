"""As-of joins against a plain one."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tremolith.operators import asof

START = dt.datetime(2024, 1, 1)


def rows(seed, n, letters):
    rng = random.Random(seed)
    when = lambda: None if rng.random() < 0.05 else START + dt.timedelta(seconds=rng.randrange(0, 900), microseconds=rng.choice((0, 500_000)))
    return [(rng.choice(letters), when(), k) for k in range(n)]


def plain(left, right, by, exact, within=None):
    out = []
    for key, t, k in left:
        best = None
        for rk, rt, v in right:
            if t is None or rt is None or (by and rk != key) or rt > t or (rt == t and not exact):
                continue
            if within is not None and (t - rt).total_seconds() > within:
                continue
            if best is None or (rt, v) > best:
                best = (rt, v)
        out.append((key, t, k, *(best or (None, None))))
    return sorted(out, key=str)


def frames(spark, left, right, kind="timestamp"):
    return spark.createDataFrame(left, f"k string, t {kind}, id int").repartition(3), spark.createDataFrame(right, f"k string, t {kind}, v int").repartition(2)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("bucket", [7.0, 120.0, 1e6])
@pytest.mark.parametrize("exact", [True, False])
def test_by_key(spark, kind, bucket, exact):
    left, right = rows(1, 200, "aaab") + [(None, START + dt.timedelta(seconds=500), -1)] * 2, rows(2, 60, "aabc") + [(None, START, 77)]
    a, b = frames(spark, left, right, kind)
    got = asof.asof_join(a, b, "t", by=("k",), bucket=bucket, tie=("v",), exact=exact, prefix="r_")
    assert got.columns == ["k", "t", "id", "r_t", "r_v"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(left, right, True, exact)


def test_without_keys_and_within(spark):
    left, right = rows(3, 150, "ab"), rows(4, 12, "ab")
    a, b = frames(spark, left, right)
    for within in (None, 30.0):
        got = asof.asof_join(a, b.drop("k"), "t", bucket=60.0, tie=("v",), within=within, prefix="r_")
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain(left, right, False, True, within)


def test_clock_times_in_another_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        left, right = rows(5, 40, "a"), rows(6, 10, "a")
        a, b = frames(spark, left, right, "timestamp_ntz")
        assert sorted((tuple(r) for r in asof.asof_join(a, b, "t", by=("k",), bucket=50.0, prefix="r_").collect()), key=str) == plain(left, right, True, True)
        assert a.filter("t IS NOT NULL").select((asof._seconds(a, "t") - F.lit(1704067200.0)).alias("s"), "t").first()["s"] < 900
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_ties_clashing_names_and_nothing(spark):
    a, b = frames(spark, [("a", START, 1)] * 3, [("a", START, 5), ("a", START, 9), ("a", START, 9)])
    got = asof.asof_join(a, b, "t", by=("k",))
    assert got.columns == ["k", "t", "id", "t", "v"] and [r[-1] for r in got.collect()] == [9, 9, 9]
    assert [r[-1] for r in asof.asof_join(a, b.limit(0), "t", by=("k",)).collect()] == [None] * 3
    assert asof.asof_join(a.limit(0), b, "t", by=("k",)).count() == 0


def test_signals_of_unequal_rates(spark):
    fast = spark.range(50).select(F.lit("s").alias("signal_id"), F.lit(0).alias("channel"), F.col("id").alias("i"), F.col("id").cast("double").alias("value"))
    slow = spark.range(7).select(F.lit("s").alias("signal_id"), F.lit(0).alias("channel"), F.col("id").alias("i"), (100.0 + F.col("id")).alias("value"))
    got = {r["i"]: r["other"] for r in asof.aligned(fast, 10.0, slow, 3.0, bucket=0.5).collect()}
    assert got == {i: 100.0 + min(6, i * 3 // 10) for i in range(50)}
