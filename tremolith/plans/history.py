"""Runs kept by date, and what changed from one to another.

Rankings of a run are one partition ``run_date`` of a Parquet table; writing a date
again replaces that date alone.  :func:`changes` compares two dates as multisets of
rows (``exceptAll`` either way), so only rows that differ are matched by key.

A key's change is ``added``, ``removed`` or ``changed``; rows that repeat a key are
numbered by rank, so each has its counterpart; null ranks and scores are values like
others; a date that has no rows is an empty run.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ("signal_id", "channel", "algorithm_id")
VALUES = ("overall_rank", "overall_score")
SCHEMA = "signal_id string, channel int, algorithm_id string, overall_rank int, overall_score double, written timestamp, run_date date"


def save(rankings: DataFrame, folder: str, run_date: str | dt.date, digits: int = 6) -> None:
    """Scores are kept to ``digits`` places, that a sum's order is no change."""
    rows = rankings.select(
        F.col("signal_id").cast("string"), F.col("channel").cast("int"), F.col("algorithm_id").cast("string"), F.col("overall_rank").cast("int"),
        F.round(F.col("overall_score").cast("double"), digits).alias("overall_score"), F.current_timestamp().alias("written"), F.lit(str(run_date)).cast("date").alias("run_date"),
    )
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(folder)


def load(spark: SparkSession, folder: str, run_date: str | dt.date | None = None) -> DataFrame:
    """All runs, or the partition of one date alone."""
    found = spark.read.schema(SCHEMA).parquet(folder)
    return found if run_date is None else found.filter(F.col("run_date") == F.lit(str(run_date)).cast("date"))


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """``run_date, rows, signals, written`` (as text, to the second), newest first."""
    found = load(spark, folder).groupBy("run_date").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("signal_id").alias("signals"), F.max("written").alias("written"))
    return found.withColumn("written", F.date_format("written", "yyyy-MM-dd HH:mm:ss")).orderBy(F.desc("run_date"))


def unchanged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both runs, as often as both have them."""
    both = [*KEYS, *VALUES]
    return old.select(*both).intersectAll(new.select(*both))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``signal_id, channel, algorithm_id, change, old_rank, new_rank, old_score,
    new_score`` of every row that differs."""
    both = [*KEYS, *VALUES]
    turn = F.row_number().over(Window.partitionBy(*KEYS).orderBy(*VALUES))
    gone = old.select(*both).exceptAll(new.select(*both)).withColumn("turn", turn)
    come = new.select(*both).exceptAll(old.select(*both)).withColumn("turn", turn)
    a = gone.select(*[F.col(c).alias(f"old_{c}") for c in (*KEYS, *VALUES, "turn")])
    b = come.select(*[F.col(c).alias(f"new_{c}") for c in (*KEYS, *VALUES, "turn")])
    same = F.lit(True)
    for c in (*KEYS, "turn"):
        same &= F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    met = a.join(b, same, "full")
    change = F.when(F.col("new_turn").isNull(), "removed").when(F.col("old_turn").isNull(), "added").otherwise("changed")
    either = lambda c: F.when(F.col("new_turn").isNull(), F.col(f"old_{c}")).otherwise(F.col(f"new_{c}")).alias(c)
    return met.select(
        *map(either, KEYS), change.alias("change"), F.col("old_overall_rank").alias("old_rank"), F.col("new_overall_rank").alias("new_rank"),
        F.col("old_overall_score").alias("old_score"), F.col("new_overall_score").alias("new_score"),
    )
