"""The twenty quality metrics, as grouped aggregates over signals and spectra."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import dsp
from . import moments
from .envelope import KEYS

# Whether more is better.
HIGHER = {
    "ffa": True, "rffi": True, "fbr": False, "er": True, "lsnr": True, "her": True, "kurtosis": True, "sk": True, "esk": True, "skewness": True,
    "ffr": True, "hsi": True, "sln": True, "hln": True, "gi": True, "ese": False, "si": False, "cf": True, "if": True, "ser": True,
}
# What a metric is without an envelope or without any match.
WITHOUT = {"fbr": 1.0, "ese": float("inf"), "si": 1.0}
TIME = ("kurtosis", "skewness", "cf", "if")


def _over(a: Column, b: Column, other: float = 0.0) -> Column:
    return F.when(F.abs(b) > 0, a / b).otherwise(other)


def _moments(v: str) -> dict[str, Column]:
    """Plain sums for moments: partial aggregation, the same in every engine."""
    return {f"m{p}": F.avg(F.pow(F.col(v), F.lit(float(p)))) for p in (1, 2, 3, 4)}


def _central(df: DataFrame) -> DataFrame:
    m1, m2, m3, m4 = (F.col(f"m{p}") for p in (1, 2, 3, 4))
    return df.withColumn("var", m2 - m1 * m1).withColumn("c3", m3 - 3 * m1 * m2 + 2 * F.pow(m1, F.lit(3.0))).withColumn(
        "c4", m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * F.pow(m1, F.lit(4.0))
    )


def _kurtosis() -> Column:
    return F.when(F.col("var") > 1e-24, F.col("c4") / (F.col("var") * F.col("var"))).otherwise(0.0)


def _melt(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.unpivot(list(KEYS), list(names), "metric", "value")


def time_metrics(samples: DataFrame) -> DataFrame:
    """kurtosis, skewness, cf and if of ``keys, i, value``: one aggregate of central
    moments, merged pairwise, in one shuffle."""
    found = moments.moments(samples, [k for k in KEYS if k != "channel"])
    return moments.time_metrics(found, list(KEYS))


def spectrum_metrics(spectra: DataFrame) -> DataFrame:
    """fbr, esk, sln, gi, ese, si of long spectra, over the bins above 0 Hz."""
    plus, keys = spectra.filter("f > 0"), Window.partitionBy(*KEYS)
    plus = plus.withColumns(
        {
            "i": F.row_number().over(keys.orderBy("s", "k")), "n": F.count(F.lit(1)).over(keys), "total": F.sum("s").over(keys), "top": F.max("s").over(keys),
            "step": F.abs(F.col("s") - F.lag("s").over(keys.orderBy("k"))), "c": F.col("s") - F.avg("s").over(keys),
        }
    )
    p = F.col("s") / (F.col("total") + 1e-12)
    wide = F.when(F.col("s") >= F.col("top") / 2, F.col("f"))
    found = plus.groupBy(*KEYS).agg(
        *[e.alias(k) for k, e in _moments("c").items()],
        F.least(_over(F.max(wide) - F.min(wide), F.max("f"), 1.0), F.lit(1.0)).alias("fbr"),
        _over(F.sqrt(F.sum(F.col("s") * F.col("s"))), F.sum("s")).alias("sln"),
        (1 - 2 * _over(F.sum((F.col("n") - F.col("i") + 0.5) * F.col("s")), F.first("n") * F.first("total"), 0.5)).alias("gi"),
        _over(F.sum(-p * F.log2(p + 1e-12)), F.log2(F.first("n").cast("double"))).alias("ese"),
        (F.stddev_pop("step") / (F.avg("step") + 1e-12)).alias("si"),
    )
    found = _central(found).withColumn("esk", _kurtosis()).withColumn("si", F.coalesce("si", F.lit(1.0)))
    return _melt(found, ("fbr", "esk", "sln", "gi", "ese", "si"))


def match_metrics(spectra: DataFrame, matches: DataFrame) -> DataFrame:
    """ffa, rffi, lsnr, ffr and hln, where anything matched."""
    keys = Window.partitionBy(*KEYS)
    low = spectra.withColumn("i", F.row_number().over(keys.orderBy("s", "k"))).withColumn("n", F.count(F.lit(1)).over(keys))
    whole = low.groupBy(*KEYS).agg(
        F.avg(F.when(F.col("f") > 0, F.col("s"))).alias("mean"), F.sum("s").alias("total"),
        F.sqrt(F.avg(F.when(F.col("i") <= F.greatest(F.floor(F.col("n") * 0.8), F.lit(1)), F.col("s") * F.col("s")))).alias("floor"),
    )
    m = matches.groupBy(*KEYS).agg(
        F.max("amplitude").alias("ffa"), F.sum("amplitude").alias("sum"), _over(F.sqrt(F.sum(F.col("amplitude") * F.col("amplitude"))), F.sum("amplitude")).alias("hln")
    )
    found = m.join(whole, list(KEYS)).select(
        *KEYS, "ffa", "hln", _over(F.col("ffa"), F.col("mean")).alias("rffi"), _over(F.col("sum"), F.col("total")).alias("ffr"),
        F.when((F.col("floor") > 0) & (F.col("ffa") > 0), 20 * F.log10(F.col("ffa") / F.col("floor"))).otherwise(40.0).alias("lsnr"),
    )
    return _melt(found, ("ffa", "rffi", "lsnr", "ffr", "hln"))


def target_metrics(spectra: DataFrame, targets: DataFrame, legacy_zero: bool = False) -> DataFrame:
    """er (energy within 3 % of any target over all) and her (within 2 % of the
    first three multiples); ``legacy_zero`` gives the constant 0 of old reports."""
    energy = F.col("s") * F.col("s")
    if legacy_zero:
        return _melt(spectra.groupBy(*KEYS).agg(F.lit(0.0).alias("er"), F.lit(0.0).alias("her")), ("er", "her"))
    near = targets.agg(F.collect_list("freq").alias("freqs"))  # a handful of rows
    met = spectra.crossJoin(F.broadcast(near))
    er = F.exists("freqs", lambda t: F.abs(F.col("f") - t) <= 0.03 * t)
    her = F.exists("freqs", lambda t: F.exists(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda h: F.abs(F.col("f") - h * t) <= 0.02 * h * t))
    found = met.groupBy(*KEYS).agg(
        _over(F.sum(F.when(er, energy).otherwise(0.0)), F.sum(energy)).alias("er"), _over(F.sum(F.when(her, energy).otherwise(0.0)), F.sum(energy)).alias("her")
    )
    return _melt(found, ("er", "her"))


def peak_metrics(spectra: DataFrame, peaks: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """ser, and hsi where anything matched.  A bin on the edge of a peak's +-10 %
    counts as inside, whatever its last digit."""
    top = peaks.filter("rank <= 3").groupBy(*KEYS).agg(F.collect_list("f").alias("tops"))  # three values
    five = peaks.filter("rank <= 5").groupBy(*KEYS).agg(F.sum(F.col("a") * F.col("a")).alias("five"))
    met = spectra.join(top, list(KEYS)).join(five, list(KEYS))
    near = F.aggregate("tops", F.lit(0), lambda n, t: n + F.when(F.abs(F.col("f") - t) <= 0.1 * t + 1e-9, 1).otherwise(0))
    out = _melt(met.groupBy(*KEYS).agg(_over(F.sum(near * F.col("s") * F.col("s")), F.first("five")).alias("ser")), ("ser",))
    if matches is None:
        return out
    alike = F.abs(F.col("a") - F.col("amplitude")) <= 0.1 * F.col("amplitude")
    found = matches.join(peaks, list(KEYS)).filter(alike).groupBy(*KEYS, "name").agg(F.min_by("f", "rank").alias("at"), F.first("amplitude").alias("amplitude"))
    beside = spectra.join(found, list(KEYS)).filter((F.abs(F.col("f") - F.col("at")) <= 0.05 * F.col("at")) & (F.col("f") != F.col("at")))
    local = beside.groupBy(*KEYS, "name").agg(F.avg("s").alias("mean"), F.first("amplitude").alias("amplitude"))
    return out.unionByName(_melt(local.groupBy(*KEYS).agg(F.avg(_over(F.col("amplitude") - F.col("mean"), F.col("mean"))).alias("hsi")), ("hsi",)))


def spectral_kurtosis(denoised: DataFrame) -> DataFrame:
    """sk: mean over bins of the kurtosis over frames of the transform's size."""

    @F.pandas_udf("double")
    def sk(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for samples, rates in batches:
            out = []
            for x, fs in zip(samples, rates, strict=True):
                size = min(256, len(x) // 4)
                if size < 2:
                    out.append(0.0)
                    continue
                a = np.abs(dsp.stft(np.asarray(x), fs, size, size // 2)[1])
                c = a - a.mean(axis=1, keepdims=True)
                var = (c * c).mean(axis=1)
                out.append(float(np.mean(np.where(var > 1e-24, (c**4).mean(axis=1) / np.maximum(var, 1e-24) ** 2, 0.0))))
            yield pd.Series(out)

    return denoised.select(*KEYS, F.lit("sk").alias("metric"), sk("denoised", "sample_rate").alias("value"))


def complete(found: DataFrame, keys: DataFrame, enabled: Iterable[str] | None = None) -> DataFrame:
    """A row for each enabled metric of each key, with its value without envelope
    or match where nothing was found, and whether more is better."""
    names = [m for m in (enabled or HIGHER) if m in HIGHER]
    listed = keys.sparkSession.createDataFrame([(m, HIGHER[m], WITHOUT.get(m, 0.0)) for m in names], "metric string, higher_is_better boolean, without double")
    every = keys.select(*KEYS).distinct().crossJoin(F.broadcast(listed))
    return every.join(found, [*KEYS, "metric"], "left").select(*KEYS, "metric", F.coalesce("value", "without").alias("value"), "higher_is_better")


def flattened_metrics(denoised: DataFrame, enabled: Iterable[str] | None = None) -> DataFrame:
    """The time metrics of each signal's channels taken as one (channel -1), as
    :func:`complete` gives them.  Channels may differ in length."""
    samples = denoised.select("signal_id", "algorithm_id", F.explode("denoised").alias("value"))
    by = ["signal_id", "algorithm_id"]
    found = moments.time_metrics(samples.groupBy(*by).agg(*moments.aggregates()), by)
    wanted = [m for m in TIME if m in set(enabled or HIGHER)]
    return found.filter(F.col("metric").isin(wanted)).select("signal_id", F.lit(moments.WHOLE).alias("channel"), "algorithm_id", "metric", "value", F.lit(True).alias("higher_is_better"))


def all_metrics(enveloped: DataFrame, spectra: DataFrame, peaks: DataFrame, matches: DataFrame, targets: DataFrame, enabled: Iterable[str] | None = None, flattened: bool = False) -> DataFrame:
    """Every enabled metric of every denoised signal; with ``flattened`` also the time
    metrics of each signal as a whole."""
    wanted = set(enabled or HIGHER)
    samples = enveloped.select(*KEYS, F.posexplode("denoised").alias("i", "value"))
    parts = {
        frozenset(TIME): lambda: time_metrics(samples), frozenset({"sk"}): lambda: spectral_kurtosis(enveloped),
        frozenset({"fbr", "esk", "sln", "gi", "ese", "si"}): lambda: spectrum_metrics(spectra), frozenset({"ffa", "rffi", "lsnr", "ffr", "hln"}): lambda: match_metrics(spectra, matches),
        frozenset({"er", "her"}): lambda: target_metrics(spectra, targets), frozenset({"ser", "hsi"}): lambda: peak_metrics(spectra, peaks, matches),
    }
    found = None
    for names, make in parts.items():
        if names & wanted:
            part = make().select(*KEYS, "metric", "value")
            found = part if found is None else found.unionByName(part)
    found = complete(found, enveloped, enabled)
    return found.unionByName(flattened_metrics(enveloped, enabled)) if flattened else found
