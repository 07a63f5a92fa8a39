"""As-of joins: each left row with the latest right row not after it.

Neither side is put in one order as a whole.  Times are cut into buckets; within a
(key, bucket) one window over the distinct times of both sides carries the last right
row on; where a bucket has none yet, the last one of an earlier bucket is carried
over, by a window over one row a bucket.  Left rows then meet their time's match by
an equal join, so any number of rows that share a time, a key or a bucket are dealt
out by Spark's own means.

Of right rows with equal key and time the one with the largest ``tie`` columns counts
(else the largest row).  Null times match nothing; null keys are a key like any
other; left rows without a match stay, with nulls; an empty side is no error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import KEYS


def asof_join(
    left: DataFrame, right: DataFrame, time: str, right_time: str | None = None, by: tuple[str, ...] = (), bucket: float = 86_400.0, tie: tuple[str, ...] = (),
    exact: bool = True, within: float | None = None, prefix: str = "",
) -> DataFrame:
    """``left`` with ``right``'s columns but the keys (named with ``prefix``).  Times
    are timestamps, or numbers; ``bucket`` and ``within`` (the greatest distance) are
    in seconds, or of the numbers' unit.  Without ``exact`` an equal time is too late."""
    right_time = right_time or time
    carried = [c for c in right.columns if c not in by]
    value = F.struct(*[F.col(f"`{c}`") for c in carried])
    order = F.struct(*[F.col(f"`{c}`") for c in tie], value) if tie else value
    keys = [f"_k{j}" for j in range(len(by))]
    r = right.select(*[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys, strict=True)], _seconds(right, right_time).alias("_t"), value.alias("_v"), order.alias("_o")).filter("_t IS NOT NULL")
    r = r.groupBy(*keys, "_t").agg(F.max_by("_v", "_o").alias("_v"))
    packed = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_l"), *[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys, strict=True)], _seconds(left, time).alias("_t"))
    times = packed.select(*keys, "_t").filter("_t IS NOT NULL").distinct()
    nothing = F.lit(None).cast(r.schema["_v"].dataType)
    # A left time after an equal right one sees it; before it, not.
    both = r.withColumn("_side", F.lit(0 if exact else 1)).unionByName(times.select(*keys, "_t", nothing.alias("_v"), F.lit(1 if exact else 0).alias("_side")))
    asks = F.col("_side") == (1 if exact else 0)
    both = both.withColumn("_b", F.floor(F.col("_t") / bucket)).withColumn("_s", F.when(F.col("_v").isNotNull(), F.struct("_t", "_v")))
    here = Window.partitionBy(*keys, "_b").orderBy("_t", "_side")
    seen = both.withColumn("_m", F.last("_s", ignorenulls=True).over(here)).filter(asks).select(*keys, "_b", "_t", "_m")
    ends = both.groupBy(*keys, "_b").agg(F.max_by("_s", F.when(F.col("_s").isNotNull(), F.col("_t"))).alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    ends = ends.withColumn("_c", F.last("_s", ignorenulls=True).over(before)).select(*[F.col(k).alias(f"{k}e") for k in keys], F.col("_b").alias("_be"), "_c")
    same = F.col("_b") == F.col("_be")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}e"))
    found = seen.join(ends, same).withColumn("_m", F.coalesce("_m", "_c"))
    if within is not None:
        found = found.withColumn("_m", F.when(F.col("_t") - F.col("_m._t") <= within, F.col("_m")))
    found = found.select(*[F.col(k).alias(f"{k}f") for k in keys], F.col("_t").alias("_tf"), F.col("_m._v").alias("_v"))
    same = F.col("_t") == F.col("_tf")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}f"))
    out = packed.join(found, same, "left")
    return out.select("_l.*", *[F.col("_v").getField(c).alias(prefix + c) for c in carried])


def _seconds(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    c = F.col(f"`{column}`")
    if kind == "timestamp":
        return F.unix_micros(c) / 1e6
    if kind in ("timestamp_ntz", "date"):  # clock times, whatever the session's zone
        return F.unix_micros(F.from_utc_timestamp(c.cast("timestamp"), F.current_timezone())) / 1e6
    return c.cast("double")


def aligned(fast: DataFrame, fast_rate: float, slow: DataFrame, slow_rate: float, bucket: float = 3600.0) -> DataFrame:
    """Two long forms on the clock of the first: ``signal_id, channel, i, value`` and
    ``other``, the second's latest sample (rates in samples a second)."""
    a = fast.withColumn("_at", F.col("i") * slow_rate)  # in steps of both, exact for whole rates
    b = slow.select(*KEYS, (F.col("i") * fast_rate).alias("_at"), F.col("value").alias("other"))
    found = asof_join(a, b, "_at", by=KEYS, bucket=bucket * fast_rate * slow_rate, prefix="_")
    return found.select(*fast.columns, F.col("_other").alias("other"))
