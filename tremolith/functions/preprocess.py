"""Preprocessing in its fixed order: DC, resampling, segments, normalisation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import dsp
from ..model import KEYS, whole


def remove_dc(samples: DataFrame) -> DataFrame:
    """Long form: each sample less its channel's mean."""
    return samples.withColumn("value", F.col("value") - F.avg("value").over(whole()))


def normalise(samples: DataFrame) -> DataFrame:
    """Long form: zero mean, unit population deviation (1 where it vanishes)."""
    spread = F.stddev_pop("value").over(whole())
    return samples.withColumn("value", (F.col("value") - F.avg("value").over(whole())) / F.when(spread < 1e-12, 1.0).otherwise(spread))


def segments(signals: DataFrame, seconds: float, overlap: float = 0.0, first_only: bool = False) -> DataFrame:
    """Array form: full segments with ``segment_id``; an overlap of 1 never ends."""
    if not 0 <= overlap < 1:
        raise ValueError("overlap lies in [0, 1)")
    n = F.floor(F.lit(seconds) * F.col("sample_rate")).cast("int")
    step = F.greatest(F.floor(n * (1 - overlap)).cast("int"), F.lit(1))
    last = F.size("samples") - F.col("seg_n")
    starts = F.when((last >= 0) & (F.col("seg_n") > 0), F.sequence(F.lit(0), last, F.col("seg_step"))).otherwise(F.array().cast("array<int>"))
    cut = signals.withColumn("seg_n", n).withColumn("seg_step", step).withColumn("starts", starts)
    if first_only:
        cut = cut.withColumn("starts", F.slice("starts", 1, 1))
    cut = cut.select("*", F.posexplode("starts").alias("segment_id", "start"))
    return cut.withColumn("samples", F.slice("samples", F.col("start") + 1, F.col("seg_n"))).drop("seg_n", "seg_step", "starts", "start")


def resample(signals: DataFrame, target_rate: float) -> DataFrame:
    """Array form: through the spectrum to floor(n * target / rate) samples."""

    @F.pandas_udf("array<double>")
    def change(samples: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([dsp.fft_resample(x, int(len(x) * target_rate / r)) if r != target_rate and len(x) else x for x, r in zip(samples, rate, strict=True)])

    return signals.withColumn("samples", change("samples", "sample_rate")).withColumn("sample_rate", F.lit(float(target_rate)))


def preprocess(signals: DataFrame, dc: bool = True, target_rate: float | None = None, seconds: float | None = None, overlap: float = 0.0, unit: bool = False) -> DataFrame:
    """All steps on the array form; of several segments the first."""

    @F.pandas_udf("array<double>")
    def centred(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: x - x.mean() if len(x) else x)

    @F.pandas_udf("array<double>")
    def scaled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: (x - x.mean()) / (x.std() if len(x) and x.std() >= 1e-12 else 1.0) if len(x) else x)

    if dc:
        signals = signals.withColumn("samples", centred("samples"))
    if target_rate:
        signals = resample(signals, target_rate)
    if seconds:
        signals = segments(signals, seconds, overlap, first_only=True).drop("segment_id")
    return signals.withColumn("samples", scaled("samples")) if unit else signals


__all__ = ["KEYS", "normalise", "preprocess", "remove_dc", "resample", "segments"]
