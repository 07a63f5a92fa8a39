"""Reports: tables for charts, CSV and HTML files, Markdown."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import HIGHER
from .catalog import catalog


def metric_table(metrics: DataFrame) -> DataFrame:
    """Operators by metrics, missing ones 0."""
    return metrics.groupBy("signal_id", "channel", "algorithm_id").pivot("metric", sorted(HIGHER)).agg(F.first("value")).fillna(0.0)


def export_table(rankings: DataFrame) -> DataFrame:
    names = catalog(rankings.sparkSession).select("algorithm_id", "name", "category")
    met = rankings.join(F.broadcast(names), "algorithm_id")
    return met.select("signal_id", "channel", "overall_rank", "algorithm_id", "name", "category", F.round("overall_score", 4).alias("score"), F.round("execution_time", 3).alias("time"))


def write_csv(rankings: DataFrame, folder: str) -> None:
    export_table(rankings).write.mode("overwrite").option("header", True).csv(folder)


def bar_rows(rankings: DataFrame) -> DataFrame:
    return rankings.select("signal_id", "channel", "overall_rank", "algorithm_id", "overall_score")


def radar_rows(metrics_normalised: DataFrame) -> DataFrame:
    return metrics_normalised.select("signal_id", "channel", "algorithm_id", "metric", "norm")


def waveform_rows(denoised: DataFrame) -> DataFrame:
    x = F.posexplode("denoised").alias("i", "value")
    return denoised.select("signal_id", "channel", "algorithm_id", "sample_rate", x).withColumn("t", F.col("i") / F.col("sample_rate"))


def _first(rankings: DataFrame, top_n: int) -> list:
    """At most top_n rows of one channel of one signal, for people to read."""
    few = export_table(rankings).orderBy("signal_id", "channel", "overall_rank").limit(top_n)
    return few.collect()


def markdown(rankings: DataFrame, top_n: int = 20, title: str = "Denoising report") -> str:
    rows = _first(rankings, top_n)
    head = ["rank", "id", "category", "score", "time (s)"]
    lines = [f"# {title}", "", f"Written {dt.datetime.now():%Y-%m-%d %H:%M:%S}.", "", "| " + " | ".join(head) + " |", "|" + " --- |" * len(head)]
    lines += [f"| {r['overall_rank']} | {r['algorithm_id']} | {r['category']} | {r['score']} | {r['time']} |" for r in rows]
    return "\n".join(lines) + "\n"


def html(rankings: DataFrame, top_n: int = 20, title: str = "Denoising report") -> str:
    from html import escape

    rows = _first(rankings, top_n)
    cells = lambda values, tag: "<tr>" + "".join(f"<{tag}>{escape(str(v))}</{tag}>" for v in values) + "</tr>"
    body = [cells(["rank", "id", "name", "category", "score", "time"], "th")]
    body += [cells([r[c] for c in ("overall_rank", "algorithm_id", "name", "category", "score", "time")], "td") for r in rows]
    return f"<!DOCTYPE html><html><head><title>{escape(title)}</title></head><body><table>{''.join(body)}</table></body></html>"


def write_markdown(rankings: DataFrame, path: str, top_n: int = 20) -> str:
    Path(path).write_text(markdown(rankings, top_n))
    return path
