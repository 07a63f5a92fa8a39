"""Test signals as projections of ``spark.range``; seeded where random."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def _clock(spark: SparkSession, sample_rate: float, duration: float) -> DataFrame:
    """i and t = i / sample_rate."""
    return spark.range(int(sample_rate * duration)).select(F.col("id").alias("i"), (F.col("id") / F.lit(float(sample_rate))).alias("t"))


def _noisy(value: Column, level: float, seed: int) -> Column:
    return value + level * F.randn(seed) if level else value


def gear_fault(spark, sample_rate, duration, gmf=500.0, shaft_freq=25.0, mod_depth=0.3, noise_level=0.0, seed=42) -> DataFrame:
    """A mesh tone, its size and phase modulated by the shaft."""
    t = F.col("t")
    size = 1 + mod_depth * F.cos(TWO_PI * shaft_freq * t)
    value = size * F.cos(TWO_PI * gmf * t + mod_depth * F.sin(TWO_PI * shaft_freq * t))
    return _clock(spark, sample_rate, duration).select("i", _noisy(value, noise_level, seed).alias("value"))


def chirp(spark, sample_rate, duration, f0=10.0, f1=1000.0, noise_level=0.0, seed=42) -> DataFrame:
    """A linear sweep from f0 to f1."""
    t = F.col("t")
    value = F.cos(TWO_PI * (f0 * t + (f1 - f0) / (2 * duration) * t * t))
    return _clock(spark, sample_rate, duration).select("i", _noisy(value, noise_level, seed).alias("value"))


def multi_harmonic(spark, sample_rate, duration, harmonics=((50.0, 1.0, 0.0),), noise_level=0.0, seed=42) -> DataFrame:
    """The sum of (frequency, amplitude, phase) sines."""
    value = F.lit(0.0)
    for f, a, phase in harmonics:
        value = value + a * F.sin(TWO_PI * f * F.col("t") + phase)
    return _clock(spark, sample_rate, duration).select("i", _noisy(value, noise_level, seed).alias("value"))


def bearing_fault(spark, sample_rate, duration, fault_freq=78.5, shaft_freq=25.0, impact_decay=0.01, noise_level=0.0, n_harmonics=3, seed=42) -> DataFrame:
    """Decaying impacts at the fault frequency and its multiples: each sample
    takes part in the few impacts of the last three decay times, so the impacts
    are made from the sample, without a join."""
    clock, t = _clock(spark, sample_rate, duration), F.col("t")
    value = F.lit(0.0)
    for h in range(1, n_harmonics + 1):
        period = 1 / (fault_freq * h)
        for back in range(int(3 * impact_decay / period) + 1):
            k = F.floor(t / period) - back
            since = t - k * period
            # Each impact's strength: normal by the Box-Muller transform of a hash, the same on any partition.
            unit = lambda s, k=k, h=h: (F.pmod(F.xxhash64(k, F.lit(h), F.lit(s), F.lit(seed)), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))
            strength = 0.5 * (1 + 0.2 * F.sqrt(-2 * F.ln(unit(1))) * F.cos(TWO_PI * unit(2)))
            hit = strength * F.exp(-since / impact_decay) * F.sin(TWO_PI * shaft_freq * h * since)
            value = value + F.when((k >= 0) & (since <= 3 * impact_decay), hit).otherwise(0.0)
    value = value * (1 + 0.3 * F.sin(TWO_PI * shaft_freq * t))
    return clock.select("i", _noisy(value, noise_level, seed).alias("value"))


def mixed_signal(spark, sample_rate, duration, signals: list[tuple[Callable[[], DataFrame], float]], noise_level=0.0, seed=42) -> DataFrame:
    """Weighted sum of generators, cut or zero-padded to the length."""
    parts = _clock(spark, sample_rate, duration).select("i", F.lit(0.0).alias("value"))
    for make, weight in signals:
        parts = parts.unionByName(make().select("i", (weight * F.col("value")).alias("value")))
    total = parts.filter(F.col("i") < int(sample_rate * duration)).groupBy("i").agg(F.sum("value").alias("value"))
    return total.select("i", _noisy(F.col("value"), noise_level, seed).alias("value"))


def as_signal(samples: DataFrame, signal_id: str, sample_rate: float) -> DataFrame:
    """The array form of one generated signal."""
    from ..model import signal_columns, to_array

    held = to_array(samples.withColumns({"signal_id": F.lit(signal_id), "channel": F.lit(0)}))
    return held.select(*signal_columns(F.col("signal_id"), F.col("samples"), sample_rate))
