"""Mergeable central moments, and the time metrics of channels and whole signals.

A row of moments (n, mean, m2, m3, m4: sums of powers of the distance from the mean;
peak, total_abs, energy) stands for any set of samples.  Rows merge pairwise without
a look at the samples again, and without sums of raw powers that lose their digits.

*   :func:`moments` aggregates samples once, map side first; with ``flattened``,
    grouping sets give each signal as a whole as well (channel -1, as if the samples
    of all channels stood in one row), in the same shuffle.
*   :func:`merged` merges stored rows of moments (of days, parts, segments) to
    coarser groups.
*   :func:`time_metrics` reads kurtosis, skewness, cf and if off the moments.

Null values are no samples; a group of nulls alone has n = 0 and metrics as of a
flat signal (0, 0, 1, 0); ties and order don't matter; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOMENTS = ("n", "mean", "m2", "m3", "m4", "peak", "total_abs", "energy")
TIME = ("kurtosis", "skewness", "cf", "if")
#: The channel of a signal's flattened row.
WHOLE = -1


def aggregates() -> list[Column]:
    """Spark's own central moments merge partial results pairwise; its skewness and
    kurtosis are those of a population, undefined where nothing varies."""
    x, n = F.col("value"), F.count("value")
    var, flat = F.coalesce(F.var_pop("value"), F.lit(0.0)), F.coalesce(F.var_pop("value"), F.lit(0.0)) <= 0
    return [
        n.alias("n"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"), (n * var).alias("m2"),
        F.when(flat, 0.0).otherwise(F.skewness("value") * n * F.pow(var, F.lit(1.5))).alias("m3"),
        F.when(flat, 0.0).otherwise((F.kurtosis("value") + 3) * n * var * var).alias("m4"),
        F.coalesce(F.max(F.abs(x)), F.lit(0.0)).alias("peak"), F.coalesce(F.sum(F.abs(x)), F.lit(0.0)).alias("total_abs"), F.coalesce(F.sum(x * x), F.lit(0.0)).alias("energy"),
    ]


def moments(samples: DataFrame, by: list[str], channel: str = "channel", flattened: bool = False) -> DataFrame:
    """``by``, ``channel`` and the moments of ``value``."""
    keys = [*by, channel]
    if not flattened:
        return samples.groupBy(*keys).agg(*aggregates())
    # The flattened row's channel is null in the grouping set; a null channel of the data is told by its grouping bit.
    found = samples.groupingSets([keys, by], *keys).agg(*aggregates(), F.grouping(channel).alias("_whole"))
    return found.withColumn(channel, F.when(F.col("_whole") == 1, WHOLE).otherwise(F.col(channel))).drop("_whole")


def _pair(a: Column, b: Column) -> Column:
    """The moments of two sets together."""
    n = a["n"] + b["n"]
    d, over = b["mean"] - a["mean"], F.when(n > 0, n.cast("double")).otherwise(1.0)
    p, q = a["n"] / over, b["n"] / over
    m2 = a["m2"] + b["m2"] + d * d * a["n"] * q
    m3 = a["m3"] + b["m3"] + d * d * d * a["n"] * q * (p - q) + 3 * d * (p * b["m2"] - q * a["m2"])
    m4 = a["m4"] + b["m4"] + F.pow(d, F.lit(4.0)) * a["n"] * q * (p * p - p * q + q * q) + 6 * d * d * (p * p * b["m2"] + q * q * a["m2"]) + 4 * d * (p * b["m3"] - q * a["m3"])
    mean = F.when(a["n"] == 0, b["mean"]).when(b["n"] == 0, a["mean"]).otherwise(a["mean"] + d * q)
    return F.struct(
        n.alias("n"), mean.alias("mean"), m2.alias("m2"), m3.alias("m3"), m4.alias("m4"),
        F.greatest(a["peak"], b["peak"]).alias("peak"), (a["total_abs"] + b["total_abs"]).alias("total_abs"), (a["energy"] + b["energy"]).alias("energy"),
    )


def merged(partial: DataFrame, by: list[str], fan_in: int = 64) -> DataFrame:
    """Rows of moments merged to ``by``, ``fan_in`` at a time and those again, so that
    no array grows with a group: a group may hold a third of all rows."""
    row = F.struct(*[F.col(m).cast("long" if m == "n" else "double").alias(m) for m in MOMENTS])
    zero = F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(m) for m in MOMENTS[1:]])
    together = F.aggregate(F.collect_list("_row"), zero, _pair)
    given = partial.select(*by, row.alias("_row"))
    most = partial.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while most > fan_in:
        salt = -(-most // fan_in)
        dealt = given.withColumn("_salt", (F.rand(17) * salt).cast("long"))
        given, most = dealt.groupBy(*by, "_salt").agg(together.alias("_row")).drop("_salt"), salt
    return given.groupBy(*by).agg(together.alias("_row")).select(*by, "_row.*")


def time_metrics(found: DataFrame, by: list[str]) -> DataFrame:
    """``by``, metric and value: kurtosis, skewness (its size), cf and if."""
    n = F.when(F.col("n") > 0, F.col("n").cast("double")).otherwise(1.0)
    var = F.col("m2") / n
    rms, mean_abs = F.sqrt(F.col("energy") / n), F.col("total_abs") / n
    varies = var > 1e-24
    wide = found.select(
        *by, F.when(varies, F.col("m4") / n / (var * var)).otherwise(0.0).alias("kurtosis"), F.when(varies, F.abs(F.col("m3") / n / F.pow(var, F.lit(1.5)))).otherwise(0.0).alias("skewness"),
        F.when(rms > 0, F.col("peak") / rms).otherwise(1.0).alias("cf"), F.when(mean_abs > 0, F.col("peak") / mean_abs).otherwise(0.0).alias("if"),
    )
    return wide.unpivot(by, list(TIME), "metric", "value")
