"""Denoisers that window expressions and array functions express by themselves.

Each maps the long form (signal_id, channel, i, value) to itself.  All share the
partitioning (signal_id, channel), so any chain of them shuffles once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels import classic
from ..model import KEYS, along, to_array, to_long, whole

OUT = (*KEYS, "i", "value")


def _at(offset: int, default: float | None = 0.0) -> Column:
    """The value ``offset`` samples ahead; zero beyond the ends."""
    if offset == 0:
        return F.col("value")
    f = F.lead if offset > 0 else F.lag
    return f("value", abs(offset), default).over(along())


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _weighted(weights) -> Column:
    """Zero-padded centred correlation; even lengths lean to the left."""
    half = len(weights) // 2
    return _sum([F.lit(float(w)) * _at(k - half) for k, w in enumerate(weights)])


def _length(df: DataFrame) -> Column:
    """The samples of the channel: a column ``n``, else counted."""
    return F.col("n") if "n" in df.columns else F.count(F.lit(1)).over(whole())


def moving_average_filter(df: DataFrame, window_size: int = 5) -> DataFrame:
    if window_size < 2:
        return df.select(*OUT)
    frame = along().rowsBetween(-(window_size // 2), (window_size - 1) // 2)
    return df.withColumn("value", F.sum("value").over(frame) / window_size).select(*OUT)


def median_filter(df: DataFrame, kernel_size: int = 5) -> DataFrame:
    half = kernel_size // 2
    near = F.array_sort(F.array(*[_at(k) for k in range(-half, half + 1)]))
    return df.withColumn("value", F.element_at(near, half + 1)).select(*OUT)


def weighted_moving_average(df: DataFrame, window_size: int = 5, weight_type: str = "triangular") -> DataFrame:
    return df.withColumn("value", _weighted(classic.weight_shape(weight_type, window_size)[::-1])).select(*OUT)


def savitzky_golay_filter(df: DataFrame, window_length: int = 11, polyorder: int = 3) -> DataFrame:
    w = max(window_length, polyorder + 2)
    w += 1 - w % 2
    half = w // 2
    basis = np.vander(np.arange(-half, half + 1), polyorder + 1, increasing=True)
    fit = basis @ np.linalg.pinv(basis)
    n, i = _length(df), F.col("i")
    near = {k: _at(k) for k in range(-(w - 1), w)}
    value = _sum([F.lit(float(fit[half][j])) * near[j - half] for j in range(w)])
    for k in range(half):  # the k-th place of the first and of the last window
        value = F.when(i == k, _sum([F.lit(float(fit[k][j])) * near[j - k] for j in range(w)])).otherwise(value)
        last = w - half + k
        value = F.when(i == n - half + k, _sum([F.lit(float(fit[last][j])) * near[j - last] for j in range(w)])).otherwise(value)
    return df.withColumn("value", value).select(*OUT)


def mirrored(df: DataFrame, r: int) -> DataFrame:
    """``r`` samples more at either end, half-sample mirrored; needs ``n``."""
    i, n = F.col("i"), F.col("n")
    wide = df.withColumn("i", F.explode(F.array(i, -1 - i, 2 * n - 1 - i)))
    return wide.filter((i >= -r) & (i < n + r))


def gaussian_filter(df: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Half-sample mirrored ends; signals of at least the kernel's radius."""
    weights = classic.gaussian_weights(sigma)
    i, n = F.col("i"), F.col("n")
    if "n" not in df.columns:
        df = mirrored(df.withColumn("n", _length(df)), len(weights) // 2)
    return df.withColumn("value", _weighted(weights)).filter((i >= 0) & (i < n)).select(*OUT)


def adaptive_median_filter(df: DataFrame, max_window_size: int = 15, initial_window_size: int = 3) -> DataFrame:
    initial_window_size, max_window_size = classic.odd_windows(initial_window_size, max_window_size)
    n, i, x = _length(df), F.col("i"), F.col("value")
    chosen = None
    for w in range(initial_window_size, max_window_size + 1, 2):
        frame = along().rowsBetween(-(w // 2), w // 2)
        low, high, mid = F.min("value").over(frame), F.max("value").over(frame), F.percentile("value", F.lit(0.5)).over(frame)
        here = F.when((low < x) & (x < high), x).otherwise(mid)
        chosen = F.when((low < mid) & (mid < high), here) if chosen is None else chosen.when((low < mid) & (mid < high), here)
    first = initial_window_size // 2
    value = F.when((i < first) | (i >= n - first), x).otherwise(chosen.otherwise(mid))
    return df.withColumn("value", value).select(*OUT)


def morphological_filter(df: DataFrame, window_size: int = 5, operation: str = "opening") -> DataFrame:
    half = window_size // 2
    steps = {"opening": "min max", "closing": "max min", "occo": "min max max min"}[operation].split()
    for step in steps:
        frame = along().rowsBetween(-half, half)
        df = df.withColumn("value", (F.min if step == "min" else F.max)("value").over(frame))
    return df.select(*OUT)


def wiener_moments(df: DataFrame, size: int) -> DataFrame:
    """Adds ``m`` and ``v``, the mean and the variance nearby."""
    frame = along().rowsBetween(-(size // 2), (size - 1) // 2)
    x = F.col("value")
    df = df.withColumn("m", F.sum("value").over(frame) / size)
    return df.withColumn("v", F.sum(x * x).over(frame) / size - F.col("m") * F.col("m"))


def wiener_value() -> Column:
    x = F.col("value")
    return F.when(F.col("v") < F.col("noise"), F.col("m")).otherwise(F.col("m") + (x - F.col("m")) * (1 - F.col("noise") / F.when(F.col("v") == 0, 1.0).otherwise(F.col("v"))))


def local_wiener(df: DataFrame, size: int) -> DataFrame:
    df = wiener_moments(df, size).withColumn("noise", F.avg("v").over(whole()))
    return df.withColumn("value", wiener_value()).select(*OUT)


def dncnn_denoise(df: DataFrame) -> DataFrame:
    return local_wiener(df, 5)


def tcn_lstm_denoise(df: DataFrame) -> DataFrame:
    return local_wiener(df, 7)


def ewma_base(df: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Array fold: fit for signals up to some thousand samples, as it appends."""
    a = min(max(alpha, 0.01), 0.99)
    start = F.struct(F.element_at("samples", 1).alias("y"), F.array().cast("array<double>").alias("out"))

    def step(state, x):
        y = a * x + (1 - a) * state["y"]
        return F.struct(y.alias("y"), F.concat(state["out"], F.array(y)).alias("out"))

    out = F.aggregate("samples", start, step, lambda s: s["out"])
    return to_long(to_array(df).withColumn("samples", out)).select(*OUT)


def kalman_filter(df: DataFrame, process_noise: float = 1e-5, measurement_noise: float = 1e-3) -> DataFrame:
    """The same fold over position, speed and their covariance [[a, b], [b, c]]."""
    q, r = process_noise, measurement_noise
    zero, one = F.lit(0.0), F.lit(1.0)
    start = F.struct(F.element_at("samples", 1).alias("x"), zero.alias("v"), one.alias("a"), zero.alias("b"), one.alias("c"), F.array().cast("array<double>").alias("out"))

    def step(s, z):
        x, a, b, c = s["x"] + s["v"], s["a"] + 2 * s["b"] + s["c"] + q, s["b"] + s["c"], s["c"] + q
        k, d, e = a / (a + r), b / (a + r), z - x
        new = x + k * e
        return F.struct(
            new.alias("x"), (s["v"] + d * e).alias("v"), ((1 - k) * a).alias("a"), ((1 - k) * b).alias("b"), (c - d * b).alias("c"), F.concat(s["out"], F.array(new)).alias("out")
        )

    out = F.aggregate("samples", start, step, lambda s: s["out"])
    return to_long(to_array(df).withColumn("samples", out)).select(*OUT)


NATIVE = {
    f.__name__: f
    for f in (
        moving_average_filter, median_filter, weighted_moving_average, savitzky_golay_filter, gaussian_filter, adaptive_median_filter,
        morphological_filter, dncnn_denoise, tcn_lstm_denoise, ewma_base, kalman_filter,
    )
}
