"""Signals as DataFrames: one row a channel with its samples, or one row a sample.

*Array form* (``signals``): signal_id, channel, channel_name, sample_rate, unit,
source_path, metadata, samples.  *Long form* (``samples``): signal_id, channel,
i, value.  Kernels take the first, window expressions the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIGNALS = (
    "signal_id string, channel int, channel_name string, sample_rate double, unit string, source_path string, metadata map<string,string>, samples array<double>"
)
KEYS = ("signal_id", "channel")


def signal_columns(signal_id: Column, samples: Column, sample_rate: float | Column, channel: Column | None = None) -> list[Column]:
    """The columns of the array form, with defaults for what is not known."""
    channel = F.lit(0) if channel is None else channel
    rate = sample_rate if isinstance(sample_rate, Column) else F.lit(float(sample_rate))
    return [
        signal_id.cast("string").alias("signal_id"), channel.cast("int").alias("channel"), F.concat(F.lit("ch_"), channel.cast("string")).alias("channel_name"),
        rate.cast("double").alias("sample_rate"), F.lit("").alias("unit"), F.lit(None).cast("string").alias("source_path"),
        F.create_map().cast("map<string,string>").alias("metadata"), samples.cast("array<double>").alias("samples"),
    ]


def to_long(signals: DataFrame, value: str = "samples") -> DataFrame:
    """One row a sample; ``i`` counts from 0.  Empty signals have no rows."""
    return signals.select(*KEYS, F.posexplode(value).alias("i", "value")).withColumn("i", F.col("i").cast("long"))


def to_array(samples: DataFrame, *carry: str) -> DataFrame:
    """Samples gathered per channel in order of ``i``; a channel is the unit of
    work, so it fits a task by definition (:func:`segments` bounds it)."""
    pairs = F.array_sort(F.collect_list(F.struct("i", "value")))
    return samples.groupBy(*KEYS, *carry).agg(F.transform(pairs, lambda p: p["value"]).alias("samples"))


def along() -> Window:
    """The window over one channel in sample order."""
    return Window.partitionBy(*KEYS).orderBy("i")


def whole() -> Window:
    return Window.partitionBy(*KEYS)


def select_channels(signals: DataFrame, *channels: int) -> DataFrame:
    return signals.filter(F.col("channel").isin(*channels))


def derived(signals: DataFrame) -> DataFrame:
    """Samples and seconds of each channel, and channels of each signal."""
    n = F.size("samples")
    each = signals.withColumns({"n_samples": n, "duration": n / F.col("sample_rate")})
    return each.withColumn("n_channels", F.count(F.lit(1)).over(Window.partitionBy("signal_id")))
