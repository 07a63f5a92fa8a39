"""Envelope spectra, their peaks, bearing frequencies and fault matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..kernels import dsp

# Bearing model, pitch and roller diameter (mm), rollers, contact angle (degrees).
BEARINGS = (
    ("6205", 39.04, 7.94, 9, 0.0),
    ("6203", 28.50, 6.75, 8, 0.0),
    ("NU205", 38.50, 7.50, 12, 0.0),
)
FAULTS = ("bpfo", "bpfi", "bsf", "ftf", "gmf", "fr")
KEYS = ("signal_id", "channel", "algorithm_id")


def bearings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BEARINGS, "model string, pitch_diameter double, roller_diameter double, n_rollers int, contact_angle double")


def bearing_frequencies(geometry: DataFrame, shaft_hz: float | Column) -> DataFrame:
    """Adds bpfo, bpfi, bsf, ftf and fr; invalid geometry has fr alone."""
    fr = shaft_hz if isinstance(shaft_hz, Column) else F.lit(float(shaft_hz))
    n, d, pitch = F.col("n_rollers"), F.col("roller_diameter"), F.col("pitch_diameter")
    ok = (pitch > 0) & (d > 0) & (n > 0)
    ratio = d / F.when(ok, pitch) * F.cos(F.radians("contact_angle"))
    return geometry.withColumns(
        {"bpfo": n * fr / 2 * (1 - ratio), "bpfi": n * fr / 2 * (1 + ratio), "bsf": F.when(ok, pitch * fr / (2 * d) * (1 - ratio * ratio)), "ftf": fr / 2 * (1 - ratio), "fr": fr}
    )


def fault_targets(spark: SparkSession, shaft_hz: float | None = None, bearing: str | None = None, manual: dict[str, float] | None = None) -> DataFrame:
    """(name, freq) rows: given frequencies, or those of a bearing at a speed."""
    if manual:
        return spark.createDataFrame([(k, float(manual[k])) for k in FAULTS if manual.get(k)], "name string, freq double")
    if shaft_hz is None:
        return spark.createDataFrame([], "name string, freq double")
    found = bearing_frequencies(bearings(spark).filter(F.col("model") == (bearing or BEARINGS[0][0])), shaft_hz)
    return found.unpivot([], ["bpfo", "bpfi", "bsf", "ftf", "fr"], "name", "freq").filter("freq IS NOT NULL")


def envelopes(denoised: DataFrame, band: tuple[float, float] | None = None, n_fft: int | None = None, order: int = 4) -> DataFrame:
    """Adds ``envelope`` (of the analytic signal), ``spectrum`` (unscaled, of the
    envelope less its mean) and ``freq``; an invalid band is not applied."""
    names = [*denoised.columns, "envelope", "spectrum", "freq"]
    schema = denoised.select("*", *[F.lit(None).cast("array<double>").alias(c) for c in names[-3:]]).schema
    at, rate = denoised.columns.index("denoised"), denoised.columns.index("sample_rate")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, 256) for whole in batches for a in range(0, whole.num_rows, 256)):
            env, spec, freq = [], [], []
            for x, fs in zip(batch.column(at).to_pylist(), batch.column(rate).to_pylist(), strict=True):
                x = np.asarray(x or [], float)
                if len(x) and band and 0 < band[0] < band[1] < fs / 2:
                    try:
                        x = dsp.sosfiltfilt(dsp.butter(order, [2 * band[0] / fs, 2 * band[1] / fs], "band"), x)
                    except ValueError:
                        pass
                e = np.abs(dsp.hilbert(x)) if len(x) else x
                env.append(e)
                spec.append(np.abs(np.fft.rfft(e - e.mean(), n_fft or len(e))) if len(e) else e)
                freq.append(np.fft.rfftfreq(n_fft or len(e), 1 / fs) if len(e) else e)
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, kind) for c in (env, spec, freq))], names=names)

    return denoised.mapInArrow(work, schema)


def spectrum_rows(found: DataFrame) -> DataFrame:
    """Long spectra: keys, bin k, freq f, magnitude s."""
    return found.select(*KEYS, F.posexplode(F.arrays_zip("freq", "spectrum")).alias("k", "z")).select(*KEYS, "k", F.col("z.freq").alias("f"), F.col("z.spectrum").alias("s"))


def _bins() -> Window:
    return Window.partitionBy(*KEYS).orderBy("k")


def dominant_peaks(spectra: DataFrame, most: int = 20) -> DataFrame:
    """Local maxima over twice the mean in the lower half of the axis (a plateau
    counts once, at its middle): the first ``most`` by frequency, ranked by size;
    without any, the largest bin."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*KEYS))
    half = spectra.withColumn("n", n).filter(F.col("k") < F.floor(F.col("n") / 2)).drop("n")
    mean = F.avg("s").over(Window.partitionBy(*KEYS))
    # Equal neighbours form one run, which is compared with the runs beside it.
    half = half.withColumn("height", 2 * mean).withColumn("new", (F.coalesce(F.lag("s").over(_bins()) != F.col("s"), F.lit(True))).cast("int"))
    runs = half.withColumn("run", F.sum("new").over(_bins())).groupBy(*KEYS, "run").agg(
        F.min("k").alias("first"), F.max("k").alias("last"), F.first("s").alias("s"), F.first("height").alias("height")
    )
    order = Window.partitionBy(*KEYS).orderBy("run")
    peak = (F.lag("s").over(order) < F.col("s")) & (F.lead("s").over(order) < F.col("s")) & (F.col("s") >= F.col("height"))
    runs = runs.withColumn("peak", F.coalesce(peak, F.lit(False))).withColumn("k", F.floor((F.col("first") + F.col("last")) / 2).cast("int"))
    any_ = F.max("peak").over(Window.partitionBy(*KEYS))
    top = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("s"), "run"))
    runs = runs.withColumn("any", any_).withColumn("top", top).filter(F.col("peak") | (~F.col("any") & (F.col("top") == 1)))
    kept = runs.withColumn("turn", F.row_number().over(Window.partitionBy(*KEYS).orderBy("k"))).filter(F.col("turn") <= most).select(*KEYS, "k")
    ranked = kept.join(spectra, [*KEYS, "k"]).withColumn("rank", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("s"), "k")))
    return ranked.select(*KEYS, "rank", "f", F.col("s").alias("a"))


def fault_matches(spectra: DataFrame, targets: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """For each target the largest bin within ``tolerance`` of it; none, no row.
    Targets are a handful of rows by construction."""
    near = F.abs(F.col("f") - F.col("freq")) / F.greatest(F.col("freq"), F.lit(1.0)) < tolerance
    return spectra.join(F.broadcast(targets), near).groupBy(*KEYS, "name").agg(F.max("s").alias("amplitude"), F.first("freq").alias("freq"))
