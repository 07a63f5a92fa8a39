"""Signals out of stored tables; column pruning and filters reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import KEYS, signal_columns, to_array
from ..operators.long import numbered


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_as_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: a signal a user, samples in order of (ts, event_id)."""
    rows = _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("signal_id"), F.lit(0).alias("channel"), "ts", "event_id", "value")
    return _numbered(rows, "ts", "event_id")


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Samples counted over the keys that later windows use, so that one shuffle
    serves them all."""
    at = Window.partitionBy("signal_id", "channel").orderBy(*order)
    return rows.withColumn("i", (F.row_number().over(at) - 1).cast("long")).select("signal_id", "channel", "i", "value")


def events_as_signals(spark: SparkSession, sf_dir: str, sample_rate: float = 1.0) -> DataFrame:
    """Array form of the same: one shuffle, by user, into as many partitions as
    the session names.  The rows are few bytes but kernels make much of them, so
    adaptive execution must not merge the partitions by their size."""
    rows = _read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "user_id")
    held = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda s: s["value"])
    return rows.groupBy("user_id").agg(held.alias("held")).select(*signal_columns(F.col("user_id"), F.col("held"), sample_rate))


def events_as_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: all events as one signal ``all``, in order of (ts, event_id).  No
    task holds it whole; see :mod:`tremolith.operators.long`."""
    rows = _read(spark, sf_dir, "events").select(F.lit("all").alias("signal_id"), F.lit(0).alias("channel"), "ts", "event_id", "value")
    return numbered(rows, KEYS, ("ts", "event_id")).select(*KEYS, "i", "value")


def embeddings_as_signals(spark: SparkSession, sf_dir: str, sample_rate: float = 1.0) -> DataFrame:
    """Array form: each vector is a signal already; no shuffle."""
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rows.select(*signal_columns(F.col("vec_id"), F.col("embedding"), sample_rate))


def lineitem_as_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: a signal a supplier, prices in order of shipping."""
    key = F.col("l_suppkey").cast("string").alias("signal_id")
    rows = _read(spark, sf_dir, "lineitem").select(key, F.lit(0).alias("channel"), F.col("l_extendedprice").alias("value"), "l_shipdate", "l_orderkey", "l_linenumber")
    return _numbered(rows, "l_shipdate", "l_orderkey", "l_linenumber")


__all__ = ["embeddings_as_signals", "events_as_one", "events_as_samples", "events_as_signals", "lineitem_as_samples", "to_array"]
