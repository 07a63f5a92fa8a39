"""Load, preprocess, denoise, envelope, metrics, scoring, ranking: one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import envelope, metrics, preprocess, scoring
from ..operators.denoise import fan_out
from ..sources import read_signals, simulate
from . import catalog, config as settings


@dataclass
class Report:
    signals: DataFrame
    denoised: DataFrame
    metrics: DataFrame
    rankings: DataFrame
    top_n: int
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Give back what was persisted; the frames are then computed anew."""
        for df in self.held:
            df.unpersist()

    def top(self) -> DataFrame:
        return self.rankings.filter(F.col("overall_rank") <= self.top_n)

    def top_signals(self) -> DataFrame:
        return self.top().join(self.denoised, ["signal_id", "channel", "algorithm_id"])


def load(spark: SparkSession, config: dict) -> DataFrame:
    if config["input"]["path"]:
        return read_signals(spark, config["input"]["path"], config["input"]["channel"], config["input"]["sample_rate"])
    s = config["simulation"]
    made = simulate.bearing_fault(spark, s["sample_rate"], s["duration"], s["fault_freq"], noise_level=s["noise_level"], seed=s["seed"])
    return simulate.as_signal(made, "simulated", s["sample_rate"])


def analyse(signals: DataFrame, config: dict | None = None, partitions: int | None = None) -> Report:
    """Everything after loading.  Denoised samples, spectra and peaks feed several
    metrics, so they are persisted (spilling to disk) until the caller ends with
    ``report.release()``."""
    config = config or settings.DEFAULTS
    spark, p, e, o = signals.sparkSession, config["preprocess"], config["envelope"], config["operators"]
    signals = preprocess.preprocess(signals, p["remove_dc"], p["target_rate"], p["segment_seconds"], p["overlap"], p["normalise"])
    plan = [(i, o["params"].get(i, {})) for i in catalog.select_ids(o["mode"], o["ids"], o["categories"])]
    denoised = fan_out(signals, plan, partitions, pad=True)
    enveloped = envelope.envelopes(denoised, e["band"], e["n_fft"]).persist()
    good = enveloped.filter("success")
    # All windows and groups of spectra are by these keys: dealt once, read by all.
    spectra = envelope.spectrum_rows(good).repartition(*metrics.KEYS).persist()
    peaks = envelope.dominant_peaks(spectra).persist()
    manual = e["manual"] or ({} if e["shaft_rpm"] or config["input"]["path"] else {"bpfo": config["simulation"]["fault_freq"]})
    targets = envelope.fault_targets(spark, e["shaft_rpm"] / 60 if e["shaft_rpm"] else None, e["bearing"], manual)
    found = metrics.all_metrics(good, spectra, peaks, envelope.fault_matches(spectra, targets, e["tolerance"]), targets, config["metrics"]["enabled"], config["metrics"]["flattened"])
    s = config["scoring"]
    score = scoring.scores(found, s["method"], s["normaliser"], s["weights"] or None)
    ranked = scoring.rankings(found, score, enveloped.filter("NOT success"))
    times = enveloped.select("signal_id", "channel", "algorithm_id", "execution_time")
    return Report(signals, enveloped, found, ranked.join(times, ["signal_id", "channel", "algorithm_id"]), config["output"]["top_n"], (enveloped, spectra, peaks))


def run(spark: SparkSession, config: dict | None = None) -> Report:
    config = config or settings.load()
    return analyse(load(spark, config), config)


def category_summary(rankings: DataFrame, operators: DataFrame) -> DataFrame:
    """Mean score and best rank by category, with the total."""
    met = rankings.join(F.broadcast(operators.select("algorithm_id", "category")), "algorithm_id")
    return met.rollup("category").agg(F.avg("overall_score").alias("mean_score"), F.min("overall_rank").alias("best_rank"), F.count(F.lit(1)).alias("rows"))


def compare(rankings: DataFrame, *ids: str) -> DataFrame:
    """Chosen operators side by side: rank and the distance to the best score."""
    best = F.max("overall_score").over(Window.partitionBy("signal_id", "channel"))
    return rankings.withColumn("behind", best - F.col("overall_score")).filter(F.col("algorithm_id").isin(*ids))
