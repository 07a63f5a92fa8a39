"""Normalising, scoring and ranking operators per signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default weights; the last two name no metric and so carry none.
DEFAULT_WEIGHTS = {"ffr": 0.20, "lsnr": 0.20, "her": 0.15, "esk": 0.15, "gi": 0.15, "execution_time": 0.10, "other": 0.05}
SIGNAL = ("signal_id", "channel")
NORMALISERS = ("minmax", "zscore", "rank", "rank_desc")
METHODS = ("weighted_sum", "topsis", "borda_count", "pareto")


def _group() -> Window:
    return Window.partitionBy(*SIGNAL, "metric")


def _better(column: str = "value") -> list[Column]:
    """Best first; ties by id."""
    signed = F.when(F.col("higher_is_better"), F.col(column)).otherwise(-F.col(column))
    return [signed.desc(), F.col("algorithm_id")]


def normalised(metrics: DataFrame, method: str = "minmax") -> DataFrame:
    """Adds ``norm`` in [0, 1] (NaN counts as 0).  ``rank`` gives the best 0, as
    that method is defined; ``rank_desc`` gives the best 1."""
    v = F.when(F.isnan("value"), 0.0).otherwise(F.col("value"))
    m = metrics.withColumn("value", v)
    if method in ("rank", "rank_desc"):
        at = (F.row_number().over(_group().orderBy(*_better())) - 1) / F.greatest(F.count(F.lit(1)).over(_group()) - 1, F.lit(1))
        return m.withColumn("norm", at if method == "rank" else 1 - at)
    if method == "zscore":
        spread = F.stddev_pop("value").over(_group())
        z = F.when(spread < 1e-12, 0.0).otherwise((F.col("value") - F.avg("value").over(_group())) / spread)
        sign = F.when(F.col("higher_is_better"), 1.0).otherwise(-1.0)
        return m.withColumn("norm", 1 / (1 + F.exp(-sign * z / 3)))
    low, high = F.min("value").over(_group()), F.max("value").over(_group())
    share = (F.col("value") - low) / (high - low)
    return m.withColumn("norm", F.when(high - low < 1e-12, 0.5).when(F.col("higher_is_better"), share).otherwise(1 - share))


def weight_table(metrics: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(metric, weight): the given or default ones; metrics without one share
    what is left of 1."""
    weights = weights or DEFAULT_WEIGHTS
    given = metrics.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], "metric string, weight double")
    named = metrics.select("metric").distinct().join(F.broadcast(given), "metric", "left")
    left = max(0.0, 1 - sum(weights.values()))
    count = F.sum(F.when(F.col("weight").isNull(), 1).otherwise(0)).over(Window.partitionBy(F.lit(0)))  # at most twenty rows
    return named.withColumn("weight", F.coalesce("weight", F.lit(left) / count)).filter("weight > 0")


def scores(metrics: DataFrame, method: str = "weighted_sum", normaliser: str = "minmax", weights: dict[str, float] | None = None) -> DataFrame:
    """signal_id, channel, algorithm_id, score."""
    if method == "weighted_sum":
        w = normalised(metrics, normaliser).join(F.broadcast(weight_table(metrics, weights)), "metric")
        return w.groupBy(*SIGNAL, "algorithm_id").agg((F.sum(F.col("weight") * F.col("norm")) / F.sum("weight")).alias("score"))
    if method == "topsis":
        u = F.col("value") / F.sqrt(F.sum(F.col("value") * F.col("value")).over(_group()) + 1e-12)
        m = metrics.withColumn("u", u)
        low, high = F.min("u").over(_group()), F.max("u").over(_group())
        best, worst = F.when(F.col("higher_is_better"), high).otherwise(low), F.when(F.col("higher_is_better"), low).otherwise(high)
        m = m.withColumn("to_best", F.pow(F.col("u") - best, F.lit(2.0))).withColumn("to_worst", F.pow(F.col("u") - worst, F.lit(2.0)))
        far, near = F.sqrt(F.sum("to_worst")), F.sqrt(F.sum("to_best"))
        return m.groupBy(*SIGNAL, "algorithm_id").agg((far / (near + far + 1e-12)).alias("score"))
    if method == "borda_count":
        place = metrics.withColumn("place", F.row_number().over(_group().orderBy(*_better()))).withColumn("n", F.count(F.lit(1)).over(_group()))
        return place.groupBy(*SIGNAL, "algorithm_id").agg((F.sum(F.col("n") - F.col("place") + 1) / F.sum("n")).alias("score"))
    if method == "pareto":
        signed = F.when(F.col("higher_is_better"), F.col("value")).otherwise(-F.col("value"))
        # A signal's operators times its metrics: the catalog bounds this array.
        row = metrics.groupBy(*SIGNAL, "algorithm_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("metric", signed.alias("v")))), lambda s: s["v"]).alias("v"))
        other = row.select(*SIGNAL, F.col("algorithm_id").alias("o"), F.col("v").alias("w"))
        both = row.join(other, list(SIGNAL))
        pairs = F.zip_with("v", "w", lambda a, b: b - a)
        beaten = F.forall(pairs, lambda d: d >= 0) & F.exists(pairs, lambda d: d > 0)
        count = both.groupBy(*SIGNAL, "algorithm_id").agg(F.sum(beaten.cast("int")).alias("dominators"))
        return count.select(*SIGNAL, "algorithm_id", (1 - F.col("dominators") / F.greatest(F.max("dominators").over(Window.partitionBy(*SIGNAL)), F.lit(1))).alias("score"))
    raise ValueError(f"unknown scoring method {method!r}")


def metric_ranks(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("metric_rank", F.row_number().over(_group().orderBy(*_better())))


def rankings(metrics: DataFrame, score: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """overall_score, overall_rank and the maps metric_scores, metric_ranks.
    Rows of ``failed`` (keys) rank behind all others, with no score where they have none."""
    maps = metric_ranks(metrics).groupBy(*SIGNAL, "algorithm_id").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metric_scores"), F.map_from_entries(F.collect_list(F.struct("metric", "metric_rank"))).alias("metric_ranks")
    )
    out = score.join(maps, [*SIGNAL, "algorithm_id"])
    bad = F.lit(0)
    if failed is not None:
        out = out.join(failed.select(*SIGNAL, "algorithm_id").distinct().withColumn("bad", F.lit(1)), [*SIGNAL, "algorithm_id"], "full")
        bad = F.coalesce("bad", F.lit(0))
    order = Window.partitionBy(*SIGNAL).orderBy(bad, F.desc("score"), "algorithm_id")
    return out.select(*SIGNAL, "algorithm_id", F.col("score").alias("overall_score"), F.row_number().over(order).alias("overall_rank"), "metric_scores", "metric_ranks")
