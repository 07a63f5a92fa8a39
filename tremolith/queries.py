"""Queries over the stored tables, one an operator, and their DuckDB twins.

Signals are the users of ``events`` (rate 1), in order of (ts, event_id).  Float
results are rounded in both engines.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import design, envelope, long_fft, metrics, moments, preprocess, scoring
from .kernels import SPECS, classic
from .model import KEYS, derived, to_array, to_long
from .operators import NATIVE, asof, denoise, long
from .operators.denoise import fan_out
from .plans import catalog, history, pipeline, runlog, search
from .shared import shared_dir, written
from .sources import embeddings_as_signals, events_as_one, events_as_samples, events_as_signals, lineitem_as_samples, simulate, slices
from .streaming import ordered

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 6

SAMPLES = """samples AS (
  SELECT CAST(user_id AS VARCHAR) AS signal_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM events)"""
CENTRED = f"""{SAMPLES}, x AS (SELECT signal_id, i, n, value - avg(value) OVER (PARTITION BY signal_id) AS value FROM samples)"""
W = "PARTITION BY signal_id ORDER BY i"

#: Parameters at which operators with cut-offs in Hz fit signals of rate 1.
AT_RATE_1 = {
    "low_pass_butterworth": {"cutoff_freq": 0.2}, "high_pass_butterworth": {"cutoff_freq": 0.05}, "band_pass_butterworth": {"low_cutoff": 0.05, "high_cutoff": 0.3},
    "band_stop_butterworth": {"low_cutoff": 0.15, "high_cutoff": 0.25}, "notch_iir": {"notch_freq": 0.2, "quality_factor": 5.0},
    "fir_band_pass": {"low_cutoff": 0.05, "high_cutoff": 0.3, "transition_width": 0.3}, "iir_band_pass": {"low_cutoff": 0.05, "high_cutoff": 0.3},
    "fft_ideal_low_pass": {"cutoff_freq": 0.2}, "cepstral_filter": {"quefrency_cutoff": 10.0}, "noise_gate_denoise": {"attack_ms": 2000, "release_ms": 4000, "hold_ms": 2000, "threshold_db": 0},
    "de_optimized_iir_notch": {"noise_freq": 50.0},
}


#: Stored values have three decimals, so means of 32 or 64 of them end in exact
#: halves; both engines round a little above those.
ABOVE = 1.23e-8


def query(name: str, sql: str | None = None):
    def wrap(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = _above_halves(sql)
        return f

    return wrap


def _above_halves(sql: str) -> str:
    """``round(x, d)`` as ``round(x + ABOVE, d)``, whatever x contains."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, comma, i = 0, -1, start + 6
        while depth >= 0:
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(sql[i], 0)
            comma = i if sql[i] == "," and depth == 0 else comma
            i += 1
        inner = _above_halves(sql[start + 6 : comma])
        out.append(f"{sql[at:start]}round({inner} + {ABOVE}{sql[comma:i]}")
        at = i
    return "".join(out) + sql[at:]


def _rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    """Rounded, with -0.0 as 0.0."""
    return df.withColumns({c: F.round(F.col(c) + ABOVE, digits) + F.lit(0.0) for c in columns})


def _long(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return _rounded(df.select("signal_id", "i", "value"), "value", digits=digits)


def _sql(value: str, tables: str = CENTRED, source: str = "x", digits: int = DIGITS, where: str = "") -> str:
    return f"WITH {tables} SELECT signal_id, i, round({value}, {digits}) + 0.0 AS value FROM {source} {where}"


def _centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.remove_dc(events_as_samples(spark, sf_dir))


def _at(k: int) -> str:
    if k == 0:
        return "value"
    return f"{'lead' if k > 0 else 'lag'}(value, {abs(k)}, 0.0) OVER w"


def _weights_sql(weights) -> str:
    half = len(weights) // 2
    terms = " + ".join(f"({float(w)!r}) * {_at(k - half)}" for k, w in enumerate(weights))
    return f"WITH {CENTRED} SELECT signal_id, i, round({terms}, {DIGITS}) + 0.0 AS value FROM x WINDOW w AS ({W})"


def _frames(steps: str) -> str:
    """Nested running minima and maxima over five samples."""
    source = "x"
    for step in steps.split():
        source = f"(SELECT signal_id, i, {step}(value) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS value FROM {source})"
    return _sql("value", source=source)


def _wiener_sql(size: int) -> str:
    half = size // 2
    frame = f"({W} ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    return f"""WITH {CENTRED}, m AS (SELECT *, sum(value) OVER {frame} / {size} AS m, sum(value * value) OVER {frame} / {size} AS q FROM x),
v AS (SELECT *, q - m * m AS v FROM m), z AS (SELECT *, avg(v) OVER (PARTITION BY signal_id) AS noise FROM v)
SELECT signal_id, i, round(CASE WHEN v < noise THEN m ELSE m + (value - m) * (1 - noise / CASE WHEN v = 0 THEN 1 ELSE v END) END, {DIGITS}) + 0.0 AS value FROM z"""


def _spectral_sql(weight: str, digits: int = DIGITS) -> str:
    """A linear filter by its weight at frequency f (cycles a sample), as the
    circular convolution that it is."""
    return f"""WITH {CENTRED}, sizes AS (SELECT DISTINCT n FROM x),
bins AS (SELECT n, k, least(k, n - k) / n AS f FROM (SELECT n, unnest(range(n)) AS k FROM sizes)),
h AS (SELECT b.n, d, sum(({weight}) * cos(2 * pi() * ((k * d) % b.n) / b.n)) / b.n AS h FROM bins b, LATERAL (SELECT unnest(range(b.n)) AS d) GROUP BY b.n, d)
SELECT x.signal_id, x.i, round(sum(y.value * h), {digits}) + 0.0 AS value
FROM x JOIN x y USING (signal_id) JOIN h ON h.n = x.n AND h.d = (x.i - y.i + x.n) % x.n GROUP BY ALL"""


def _skirt(ratio: float) -> str:
    return f"CASE WHEN f <= {ratio / 2} THEN 1 ELSE exp(-pow((f - {ratio / 2}) / 0.05, 2)) END"


def _savgol_sql() -> str:
    half, w = 5, 11
    basis = np.vander(np.arange(-half, half + 1), 4, increasing=True)
    fit = basis @ np.linalg.pinv(basis)
    rows = ", ".join(f"({a}, {b}, {float(fit[a][b])!r})" for a in range(w) for b in range(w))
    return f"""WITH {CENTRED}, fit(a, b, c) AS (VALUES {rows}),
place AS (SELECT signal_id, i, CASE WHEN i < {half} THEN i WHEN i >= n - {half} THEN i - (n - {w}) ELSE {half} END AS a FROM x)
SELECT p.signal_id, p.i, round(sum(c * y.value), {DIGITS}) + 0.0 AS value
FROM place p JOIN fit USING (a) JOIN x y ON y.signal_id = p.signal_id AND y.i = p.i - a + b GROUP BY ALL"""


def _gauss_sql() -> str:
    w = classic.gaussian_weights(2.0)
    r = len(w) // 2
    rows = ", ".join(f"({k - r}, {float(v)!r})" for k, v in enumerate(w))
    return f"""WITH {CENTRED}, g(d, c) AS (VALUES {rows})
SELECT x.signal_id, x.i, round(sum(c * y.value), {DIGITS}) + 0.0 AS value
FROM x CROSS JOIN g JOIN x y ON y.signal_id = x.signal_id
 AND y.i = CASE WHEN x.i + d < 0 THEN -1 - x.i - d WHEN x.i + d >= x.n THEN 2 * x.n - 1 - x.i - d ELSE x.i + d END GROUP BY ALL"""


def _adaptive_sql() -> str:
    parts, cases = [], []
    for w in range(3, 16, 2):
        frame = f"({W} ROWS BETWEEN {w // 2} PRECEDING AND {w // 2} FOLLOWING)"
        parts.append(f"min(value) OVER {frame} AS a{w}, median(value) OVER {frame} AS m{w}, max(value) OVER {frame} AS b{w}")
        cases.append(f"WHEN a{w} < m{w} AND m{w} < b{w} THEN CASE WHEN a{w} < value AND value < b{w} THEN value ELSE m{w} END")
    return f"""WITH {CENTRED}, z AS (SELECT *, {", ".join(parts)} FROM x)
SELECT signal_id, i, round(CASE WHEN i < 1 OR i >= n - 1 THEN value {" ".join(cases)} ELSE m15 END, {DIGITS}) + 0.0 AS value FROM z"""


_KALMAN = f"""WITH RECURSIVE {CENTRED}, run AS (
  SELECT signal_id, CAST(-1 AS BIGINT) AS i, n, value AS p, 0.0::DOUBLE AS v, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS c FROM x WHERE i = 0
  UNION ALL
  SELECT signal_id, i, n, p1 + (a1 / s) * e, v + (b1 / s) * e, (1 - a1 / s) * a1, (1 - a1 / s) * b1, c1 - (b1 / s) * b1
  FROM (SELECT r.signal_id, x.i, x.n, r.p + r.v AS p1, r.v AS v, r.a + 2 * r.b + r.c + 1e-5 AS a1, r.b + r.c AS b1, r.c + 1e-5 AS c1,
               r.a + 2 * r.b + r.c + 1e-5 + 1e-3 AS s, x.value - (r.p + r.v) AS e
        FROM run r JOIN x ON x.signal_id = r.signal_id AND x.i = r.i + 1))
SELECT signal_id, i, round(p, {DIGITS}) + 0.0 AS value FROM run WHERE i >= 0"""

_DCT = f"""WITH {CENTRED}, c AS (
  SELECT signal_id, k, any_value(n) AS n, sum(value * cos(pi() * k * (2 * i + 1) / (2 * n))) * sqrt(CASE WHEN k = 0 THEN 1 ELSE 2 END / any_value(n)) AS c
  FROM x, LATERAL (SELECT unnest(range(x.n)) AS k) GROUP BY signal_id, k),
top AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY abs(c) DESC, k) <= 20)
SELECT x.signal_id, x.i, round(sum(c * sqrt(CASE WHEN k = 0 THEN 1 ELSE 2 END / x.n) * cos(pi() * k * (2 * x.i + 1) / (2 * x.n))), {DIGITS}) + 0.0 AS value
FROM x JOIN top USING (signal_id) GROUP BY ALL"""

_SUBTRACTION = f"""WITH {SAMPLES}, x AS (SELECT * FROM samples), z AS (
  SELECT signal_id, k, any_value(n) AS n, sum(value * cos(2 * pi() * ((k * i) % n) / n)) AS re, -sum(value * sin(2 * pi() * ((k * i) % n) / n)) AS im
  FROM x, LATERAL (SELECT unnest(range(x.n)) AS k) GROUP BY signal_id, k),
s AS (SELECT *, sqrt(re * re + im * im) AS size FROM z),
noise AS (SELECT signal_id, avg(size) AS noise FROM s WHERE k < greatest(CAST(floor(n * 0.1) AS BIGINT), 10) GROUP BY signal_id),
g AS (SELECT signal_id, k, s.n, re, im, greatest(size - noise, 0.01 * noise) / size AS gain FROM s JOIN noise USING (signal_id) WHERE size > 1e-9)
SELECT x.signal_id, x.i, round(sum(gain * (re * cos(2 * pi() * ((k * x.i) % x.n) / x.n) - im * sin(2 * pi() * ((k * x.i) % x.n) / x.n))) / x.n, {DIGITS}) + 0.0 AS value
FROM x JOIN g USING (signal_id) GROUP BY x.signal_id, x.i, x.n"""

DENOISE_SQL = {
    "moving_average_filter": _sql(f"sum(value) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5"),
    "median_filter": f"WITH {CENTRED} SELECT signal_id, i, round(list_sort([{', '.join(_at(k) for k in range(-2, 3))}])[3], {DIGITS}) + 0.0 AS value FROM x WINDOW w AS ({W})",
    "weighted_moving_average": _weights_sql(classic.weight_shape("triangular", 5)),
    "savitzky_golay_filter": _savgol_sql(),
    "gaussian_filter": _gauss_sql(),
    "adaptive_median_filter": _adaptive_sql(),
    "morphological_filter": _frames("min max"),
    "dncnn_denoise": _wiener_sql(5),
    "tcn_lstm_denoise": _wiener_sql(7),
    "ewma_base": f"""WITH {CENTRED} SELECT x.signal_id, x.i, round(sum(y.value * CASE WHEN y.i = 0 THEN 1 ELSE 0.3 END * pow(0.7, x.i - y.i)), {DIGITS}) + 0.0 AS value
FROM x JOIN x y ON y.signal_id = x.signal_id AND y.i <= x.i GROUP BY ALL""",
    "kalman_filter": _KALMAN,
    "fft_ideal_low_pass": _spectral_sql("CASE WHEN f <= 0.2 THEN 1 ELSE 0 END"),
    "dae_denoise": _spectral_sql(_skirt(0.15)),
    "unet_denoise": _spectral_sql(_skirt(0.15)),
    "drsn_denoise": _spectral_sql(_skirt(0.15)),
    "transformer_denoise": _spectral_sql(_skirt(0.10)),
    "compressed_sensing_denoise": _DCT,
    "spectral_subtraction": _SUBTRACTION,
}


def _denoiser(operator_id: str) -> Query:
    def native(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _long(NATIVE[operator_id](_centred(spark, sf_dir)))

    def kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
        # A bin of exactly nothing has no phase to keep: there the mean stays.  Samples of a
        # signal on which the operator failed are null.
        found = denoise(events_as_signals(spark, sf_dir), operator_id, AT_RATE_1.get(operator_id, {}), centred=operator_id != "spectral_subtraction")
        return _long(to_long(found, "denoised"))

    return native if operator_id in NATIVE else kernel


for _id in SPECS:
    query(f"denoise_{_id}", DENOISE_SQL.get(_id))(_denoiser(_id))


# All events as one signal, whose windows no task could hold: cut into parts of LONG_PART.
LONG_PART = 4096
_ONE = """samples AS (
  SELECT 'all' AS signal_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, value, count(*) OVER () AS n
  FROM events)"""


def _long_denoiser(operator_id: str) -> Query:
    return lambda spark, sf_dir: _long(long.filtered(long.centred(events_as_one(spark, sf_dir)), operator_id, LONG_PART))


for _id in NATIVE:
    query(f"long_{_id}", DENOISE_SQL[_id].replace(SAMPLES, _ONE))(_long_denoiser(_id))


@query("long_normalise", _sql("(value - avg(value) OVER ()) / CASE WHEN stddev_pop(value) OVER () < 1e-12 THEN 1 ELSE stddev_pop(value) OVER () END", _ONE, "samples"))
def long_normalise(spark, sf_dir):
    return _long(long.scaled(events_as_one(spark, sf_dir)))


@query("source_wav_slices", f"WITH {SAMPLES} SELECT signal_id, i, value FROM samples WHERE i >= 5 AND i < 60")
def source_wav_slices(spark, sf_dir):
    """Signals written as WAV files and read back by byte ranges; the sample range
    reaches the reader."""
    path = f"{shared_dir(spark)}/wav-{uuid.uuid4().hex[:12]}"
    signals = events_as_samples(spark, sf_dir).repartition("signal_id").sortWithinPartitions("signal_id", "channel", "i")
    slices.write_slices(signals, path)
    return slices.read_slices(spark, path).filter("i >= 5 AND i < 60").select("signal_id", "i", "value")


@query("morphology_closing", _frames("max min"))
def morphology_closing(spark, sf_dir):
    return _long(NATIVE["morphological_filter"](_centred(spark, sf_dir), operation="closing"))


@query("morphology_occo", _frames("min max max min"))
def morphology_occo(spark, sf_dir):
    return _long(NATIVE["morphological_filter"](_centred(spark, sf_dir), operation="occo"))


@query("scan_events_signals", f"WITH {SAMPLES} SELECT signal_id, count(*) AS n_samples, round(avg(value), 6) AS mean FROM samples GROUP BY signal_id")
def scan_events_signals(spark, sf_dir):
    s = derived(events_as_signals(spark, sf_dir)).select("signal_id", F.col("n_samples").cast("long"), "samples")
    return _rounded(s.select("signal_id", "n_samples", (F.aggregate("samples", F.lit(0.0), lambda a, b: a + b) / F.col("n_samples")).alias("mean")), "mean")


@query("scan_embedding_signals", "SELECT CAST(vec_id AS VARCHAR) AS signal_id, len(embedding) AS n_samples, round(list_sum(list_transform(embedding, lambda e: e::DOUBLE * e)), 4) AS energy FROM embeddings")
def scan_embedding_signals(spark, sf_dir):
    s = embeddings_as_signals(spark, sf_dir)
    energy = F.aggregate("samples", F.lit(0.0), lambda a, b: a + b * b)
    return _rounded(s.select("signal_id", F.size("samples").cast("long").alias("n_samples"), energy.alias("energy")), "energy", digits=4)


@query(
    "scan_lineitem_signals",
    "SELECT CAST(l_suppkey AS VARCHAR) AS signal_id, count(*) AS n_samples, round(max(l_extendedprice), 2) AS peak FROM lineitem GROUP BY l_suppkey",
)
def scan_lineitem_signals(spark, sf_dir):
    return lineitem_as_samples(spark, sf_dir).groupBy("signal_id").agg(F.count(F.lit(1)).alias("n_samples"), F.round(F.max("value"), 2).alias("peak"))


@query("lineitem_moving_average", """WITH x AS (SELECT CAST(l_suppkey AS VARCHAR) AS signal_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS i, l_extendedprice AS value FROM lineitem)
SELECT signal_id, i, round(sum(value) OVER (PARTITION BY signal_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 4) + 0.0 AS value FROM x""")
def lineitem_moving_average(spark, sf_dir):
    return _long(NATIVE["moving_average_filter"](lineitem_as_samples(spark, sf_dir)), 4)


@query("preprocess_remove_dc", _sql("value"))
def preprocess_remove_dc(spark, sf_dir):
    return _long(_centred(spark, sf_dir))


@query("preprocess_normalise", _sql("(value - avg(value) OVER p) / CASE WHEN stddev_pop(value) OVER p < 1e-12 THEN 1 ELSE stddev_pop(value) OVER p END", SAMPLES, "samples", where="WINDOW p AS (PARTITION BY signal_id)"))
def preprocess_normalise(spark, sf_dir):
    return _long(preprocess.normalise(events_as_samples(spark, sf_dir)))


@query("preprocess_segment", f"""WITH {SAMPLES}, cut AS (SELECT *, unnest(range(0, n - 16 + 1, 8)) AS start FROM samples)
SELECT signal_id, start // 8 AS segment_id, round(avg(value), 6) AS mean, count(*) AS n FROM cut WHERE i >= start AND i < start + 16 GROUP BY ALL""")
def preprocess_segment(spark, sf_dir):
    cut = preprocess.segments(events_as_signals(spark, sf_dir), 16.0, 0.5)
    mean = F.aggregate("samples", F.lit(0.0), lambda a, b: a + b) / F.size("samples")
    return _rounded(cut.select("signal_id", F.col("segment_id").cast("long"), mean.alias("mean"), F.size("samples").cast("long").alias("n")), "mean")


@query("preprocess_resample", f"""WITH {SAMPLES}, z AS (
  SELECT signal_id, q, any_value(n) AS n, n // 2 AS m, sum(value * cos(2 * pi() * ((q * i) % n) / n)) AS re, -sum(value * sin(2 * pi() * ((q * i) % n) / n)) AS im
  FROM (SELECT *, unnest(range(n // 2 // 2 + 1)) AS q FROM samples) GROUP BY signal_id, q, n),
t AS (SELECT *, unnest(range(m)) AS i FROM z)
SELECT signal_id, i, round(sum(CASE WHEN q = 0 THEN re ELSE 2 * (re * cos(2 * pi() * ((q * i) % m) / m) - im * sin(2 * pi() * ((q * i) % m) / m)) END) / any_value(n), {DIGITS}) + 0.0 AS value FROM t GROUP BY signal_id, i""")
def preprocess_resample(spark, sf_dir):
    return _long(to_long(preprocess.resample(events_as_signals(spark, sf_dir), 0.5)))


_CLOCK = "WITH c AS (SELECT i, i / {fs}::DOUBLE AS t FROM (SELECT unnest(range({n})) AS i))"


def _simulated(value: str, fs: int = 12000, n: int = 12000) -> str:
    return _CLOCK.format(fs=fs, n=n) + f" SELECT i, round({value}, 6) + 0.0 AS value FROM c"


@query("simulate_gear_fault", _simulated("(1 + 0.3 * cos(2 * pi() * 25 * t)) * cos(2 * pi() * 500 * t + 0.3 * sin(2 * pi() * 25 * t))"))
def simulate_gear_fault(spark, sf_dir):
    return _rounded(simulate.gear_fault(spark, 12000.0, 1.0), "value")


@query("simulate_chirp", _simulated("cos(2 * pi() * (10 * t + 495 * t * t))"))
def simulate_chirp(spark, sf_dir):
    return _rounded(simulate.chirp(spark, 12000.0, 1.0), "value")


@query("simulate_multi_harmonic", _simulated("sin(2 * pi() * 50 * t) + 0.5 * sin(2 * pi() * 100 * t + 0.1)"))
def simulate_multi_harmonic(spark, sf_dir):
    return _rounded(simulate.multi_harmonic(spark, 12000.0, 1.0, [(50.0, 1.0, 0.0), (100.0, 0.5, 0.1)]), "value")


@query("simulate_mixed_signal", _simulated("0.7 * cos(2 * pi() * (10 * t + 495 * t * t)) + CASE WHEN i < 6000 THEN 0.3 * sin(2 * pi() * 50 * t) ELSE 0 END"))
def simulate_mixed_signal(spark, sf_dir):
    parts = [(lambda: simulate.chirp(spark, 12000.0, 1.0), 0.7), (lambda: simulate.multi_harmonic(spark, 12000.0, 0.5), 0.3)]
    return _rounded(simulate.mixed_signal(spark, 12000.0, 1.0, parts), "value")


@query("simulate_bearing_fault")
def simulate_bearing_fault(spark, sf_dir):
    return _rounded(simulate.bearing_fault(spark, 12000.0, 1.0, noise_level=0.3), "value")


def _raw(spark, sf_dir) -> DataFrame:
    """The centred signals themselves, in the form of a denoising result."""
    signals = preprocess.preprocess(events_as_signals(spark, sf_dir))
    return signals.select("signal_id", "channel", "sample_rate", F.lit("raw").alias("algorithm_id"), F.col("samples").alias("denoised"))


def _spectra(spark, sf_dir) -> DataFrame:
    """Envelope spectra of the centred signals; persisted, as metrics read them
    several times."""
    return envelope.spectrum_rows(envelope.envelopes(_raw(spark, sf_dir))).persist()


# The analytic signal's imaginary part is a circular convolution, the spectrum a DFT.
SPECTRUM_SQL = f"""{CENTRED}, sizes AS (SELECT DISTINCT n FROM x),
q AS (SELECT n, d, sum(CASE WHEN k > 0 AND 2 * k < n THEN 2 ELSE 0 END * sin(2 * pi() * ((k * d) % n) / n)) / n AS q
      FROM (SELECT n, d, unnest(range(n)) AS k FROM (SELECT n, unnest(range(n)) AS d FROM sizes)) GROUP BY n, d),
im AS (SELECT x.signal_id, x.i, x.n, any_value(x.value) AS re, sum(y.value * q) AS im FROM x JOIN x y USING (signal_id) JOIN q ON q.n = x.n AND q.d = (x.i - y.i + x.n) % x.n GROUP BY x.signal_id, x.i, x.n),
env AS (SELECT signal_id, i, n, sqrt(re * re + im * im) AS e FROM im),
c AS (SELECT signal_id, i, n, e - avg(e) OVER (PARTITION BY signal_id) AS e FROM env),
spectrum AS (SELECT signal_id, k, k / n AS f, sqrt(pow(sum(e * cos(2 * pi() * ((k * i) % n) / n)), 2) + pow(sum(e * sin(2 * pi() * ((k * i) % n) / n)), 2)) AS s
             FROM (SELECT *, unnest(range(n // 2 + 1)) AS k FROM c) GROUP BY signal_id, k, n)"""


@query("envelope_spectrum", f"WITH {SPECTRUM_SQL} SELECT signal_id, k, round(f, 6) AS f, round(s, 4) + 0.0 AS s FROM spectrum")
def envelope_spectrum(spark, sf_dir):
    found = envelope.spectrum_rows(envelope.envelopes(_raw(spark, sf_dir)))
    return _rounded(_rounded(found.select("signal_id", F.col("k").cast("long").alias("k"), "f", "s"), "f"), "s", digits=4)


PEAKS_SQL = f"""{SPECTRUM_SQL}, half AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY signal_id) AS bins FROM spectrum) WHERE k < bins // 2),
near AS (SELECT *, 2 * avg(s) OVER (PARTITION BY signal_id) AS height, lag(s) OVER v AS a, lead(s) OVER v AS b FROM half WINDOW v AS (PARTITION BY signal_id ORDER BY k)),
flag AS (SELECT *, coalesce(a < s AND b < s AND s >= height, false) AS peak FROM near),
pick AS (SELECT *, bool_or(peak) OVER (PARTITION BY signal_id) AS found, row_number() OVER (PARTITION BY signal_id ORDER BY s DESC, k) AS top FROM flag),
kept AS (SELECT * FROM pick WHERE peak OR (NOT found AND top = 1) QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY k) <= 20),
peaks AS (SELECT signal_id, row_number() OVER (PARTITION BY signal_id ORDER BY s DESC, k) AS rank, f, s AS a FROM kept)"""


@query("envelope_peaks", f"WITH {PEAKS_SQL} SELECT signal_id, rank, round(f, 6) AS f, round(a, 4) AS a FROM peaks")
def envelope_peaks(spark, sf_dir):
    found = envelope.dominant_peaks(_spectra(spark, sf_dir)).select("signal_id", F.col("rank").cast("long").alias("rank"), "f", "a")
    return _rounded(_rounded(found, "f"), "a", digits=4)


#: Off any k / n, so that no bin lies on the edge of a tolerance.
TARGETS = {"bpfo": 0.1037, "bpfi": 0.1519, "fr": 0.0311}
_TARGET_ROWS = ", ".join(f"('{k}', {v})" for k, v in TARGETS.items())
MATCH_SQL = f"""targets(name, freq) AS (VALUES {_TARGET_ROWS}),
matches AS (SELECT signal_id, name, max(s) AS amplitude FROM spectrum JOIN targets ON abs(f - freq) / greatest(freq, 1.0) < 0.02 GROUP BY signal_id, name)"""


def _targets(spark) -> DataFrame:
    return envelope.fault_targets(spark, manual=TARGETS)


@query("envelope_fault_matches", f"WITH {SPECTRUM_SQL}, {MATCH_SQL} SELECT signal_id, name, round(amplitude, 4) AS amplitude FROM matches")
def envelope_fault_matches(spark, sf_dir):
    found = envelope.fault_matches(_spectra(spark, sf_dir), _targets(spark))
    return _rounded(found.select("signal_id", "name", "amplitude"), "amplitude", digits=4)


_B = ", ".join(f"('{m}', {p}, {d}, {n}, {math.radians(a)})" for m, p, d, n, a in envelope.BEARINGS)


@query("envelope_bearing_frequencies", f"""WITH b(model, pitch, d, n, a) AS (VALUES {_B}), r AS (SELECT *, d / pitch * cos(a) AS q FROM b)
SELECT model, round(n * 25 / 2 * (1 - q), 6) AS bpfo, round(n * 25 / 2 * (1 + q), 6) AS bpfi, round(pitch * 25 / (2 * d) * (1 - q * q), 6) AS bsf, round(25 / 2 * (1 - q), 6) AS ftf, 25.0::DOUBLE AS fr FROM r""")
def envelope_bearing_frequencies(spark, sf_dir):
    found = envelope.bearing_frequencies(envelope.bearings(spark), 25.0)
    return _rounded(found.select("model", "bpfo", "bpfi", "bsf", "ftf", "fr"), "bpfo", "bpfi", "bsf", "ftf")


def _metric_rows(df: DataFrame) -> DataFrame:
    return _rounded(df.select("signal_id", "metric", "value"), "value", digits=4)


_MOMENTS = "avg(c * c) AS m2, avg(c * c * c) AS m3, avg(c * c * c * c) AS m4"


@query("metrics_time", f"""WITH {CENTRED}, m AS (
  SELECT signal_id, avg(value * value) AS m2, avg(value * value * value) AS m3, avg(value * value * value * value) AS m4, max(abs(value)) AS peak, avg(abs(value)) AS mean_abs FROM x GROUP BY signal_id)
SELECT signal_id, metric, round(value, 4) AS value FROM (SELECT signal_id, m4 / (m2 * m2) AS kurtosis, abs(m3 / pow(m2, 1.5)) AS skewness, peak / sqrt(m2) AS cf, peak / mean_abs AS "if" FROM m)
UNPIVOT (value FOR metric IN (kurtosis, skewness, cf, "if"))""")
def metrics_time(spark, sf_dir):
    samples = _centred(spark, sf_dir).withColumn("algorithm_id", F.lit("raw"))
    return _metric_rows(metrics.time_metrics(samples))


# Suppliers as signals, line numbers as channels, prices as samples; -1 is all channels.
_FLAT = """x AS (SELECT CAST(l_suppkey AS VARCHAR) AS signal_id, l_linenumber AS channel, l_extendedprice AS value FROM lineitem),
both_ AS (SELECT * FROM x UNION ALL SELECT signal_id, -1, value FROM x),
c AS (SELECT *, value - avg(value) OVER (PARTITION BY signal_id, channel) AS c FROM both_),
m AS (SELECT signal_id, channel, count(*) AS n, avg(c * c) AS m2, avg(c * c * c) AS m3, avg(c * c * c * c) AS m4, max(abs(value)) AS peak, avg(abs(value)) AS mean_abs, sqrt(avg(value * value)) AS rms FROM c GROUP BY ALL)"""
_FLAT_METRICS = """SELECT signal_id, channel, metric, round(value, 5) + 0.0 AS value FROM (
  SELECT signal_id, channel, CASE WHEN m2 > 1e-24 THEN m4 / (m2 * m2) ELSE 0 END AS kurtosis, CASE WHEN m2 > 1e-24 THEN abs(m3 / pow(m2, 1.5)) ELSE 0 END AS skewness,
         peak / rms AS cf, peak / mean_abs AS "if" FROM m) UNPIVOT (value FOR metric IN (kurtosis, skewness, cf, "if"))"""


def _price_samples(spark, sf_dir, *more) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(F.col("l_suppkey").cast("string").alias("signal_id"), F.col("l_linenumber").alias("channel"), F.col("l_extendedprice").alias("value"), *more)


def _event_stream(spark, sf_dir) -> DataFrame:
    """The stored events as a stream (signal_id, ts, value)."""
    path = f"{sf_dir}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")  # a single file only by a pattern
    return rows.select(F.col("user_id").cast("string").alias("signal_id"), F.col("ts").cast("timestamp").alias("ts"), "value")


def _drained(spark, stream: DataFrame) -> DataFrame:
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    return ordered.drained(stream, f"{path}/out", f"{path}/checkpoint")


# What the watermark (a day behind the last event, in whole milliseconds) has passed.
_PASSED = "passed AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY AS w FROM events)"
_SESSIONS = f"""{_PASSED}, marks AS (SELECT CAST(user_id AS VARCHAR) AS signal_id, ts, value, event_id,
  coalesce(ts - lag(ts) OVER v >= INTERVAL 12 HOUR, true) AS fresh FROM events WINDOW v AS (PARTITION BY user_id ORDER BY ts, value)),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY signal_id ORDER BY ts, value, event_id) AS session FROM marks)"""


@query("stream_sessions", f"""WITH {_SESSIONS} SELECT signal_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, round(sqrt(avg(value * value)), 6) AS rms, round(avg(value), 6) AS mean, count(*) AS n
FROM s, passed GROUP BY signal_id, session, w HAVING max(ts) + INTERVAL 12 HOUR <= w""")
def stream_sessions(spark, sf_dir):
    """Levels of the sessions that are over when the stream has been read."""
    found = _drained(spark, ordered.session_levels(_event_stream(spark, sf_dir), "1 day", "12 hours"))
    return _rounded(found.select("signal_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "rms", "mean", "n"), "rms", "mean")


@query("stream_ewma", f"""WITH {_SESSIONS}, k AS (SELECT *, row_number() OVER (PARTITION BY signal_id, session ORDER BY ts, value, event_id) AS k FROM s)
SELECT a.signal_id, strftime(a.ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, round(sum(b.value * CASE WHEN b.k = 1 THEN 1 ELSE 0.3 END * pow(0.7, a.k - b.k)), {DIGITS}) + 0.0 AS value
FROM k a JOIN k b USING (signal_id, session), passed WHERE b.k <= a.k AND a.ts <= w GROUP BY a.signal_id, a.ts, a.event_id""")
def stream_ewma(spark, sf_dir):
    """Each session smoothed in the order of its events, whatever the batches."""
    found = _drained(spark, ordered.denoise_ordered(_event_stream(spark, sf_dir), "ewma_base", {}, "1 day", "12 hours"))
    return _rounded(found.select("signal_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.col("denoised").alias("value")), "value")


@query("asof_events", """WITH l AS (SELECT * FROM events WHERE event_type <> 'error'), r AS (SELECT * FROM events WHERE event_type = 'error')
SELECT l.event_id, r.event_id AS error_id, r.value AS error_value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_events(spark, sf_dir):
    """Every event with its user's latest error before it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "value", "event_type")
    errors = events.filter("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("id"), "value")
    found = asof.asof_join(events.filter("event_type <> 'error'").select("event_id", "user_id", "ts"), errors, "ts", by=("user_id",), prefix="error_")
    return found.select("event_id", "error_id", "error_value")


@query("asof_shipments", """WITH r AS (SELECT o_orderdate, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderdate)
SELECT l_orderkey, l_linenumber, r.o_orderkey AS last_order, r.o_orderdate AS last_date FROM lineitem l ASOF LEFT JOIN r ON l.l_shipdate > r.o_orderdate""")
def asof_shipments(spark, sf_dir):
    """Every shipment with the last finished order of an earlier day, whoever's: one
    order of time for all rows, with many ties."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("last_order"), F.col("o_orderdate").alias("last_date"))
    found = asof.asof_join(lines, orders, "l_shipdate", "last_date", bucket=30 * 86_400.0, tie=("last_order",), exact=False)
    return found.select("l_orderkey", "l_linenumber", "last_order", "last_date")


@query("design_lagged_sums", f"WITH {CENTRED} SELECT signal_id, k, round(sum(p), 4) + 0.0 AS r FROM (" + " UNION ALL ".join(
    f"SELECT signal_id, {k} AS k, value * {_at(k)} AS p FROM x WINDOW w AS ({W})" for k in range(6)) + ") GROUP BY signal_id, k")
def design_lagged_sums(spark, sf_dir):
    found = design.lagged_sums(_centred(spark, sf_dir), 5, LONG_PART).select("signal_id", F.posexplode("r").alias("k", "r"))
    return _rounded(found.withColumn("k", F.col("k").cast("long")), "r", digits=4)


def _prediction_sql(tables: str, sums: str) -> str:
    """Two weights by Cramer's rule from a, b, c (the matrix) and d, e (the right side)."""
    return f"""WITH {tables}, lag AS (SELECT *, lag(value, 1, 0.0) OVER w AS x1, lag(value, 2, 0.0) OVER w AS x2, lead(value, 1, 0.0) OVER w AS y1, lead(value, 2, 0.0) OVER w AS y2 FROM x WINDOW w AS ({W})),
g AS (SELECT signal_id, {sums} FROM lag GROUP BY signal_id)
SELECT signal_id, i, round(CASE WHEN i = 0 THEN value ELSE ((d * c - b * e) * x1 + (a * e - b * d) * x2) / (a * c - b * b) END, {DIGITS}) + 0.0 AS value FROM lag JOIN g USING (signal_id)"""


@query("design_wiener", _prediction_sql(CENTRED, "sum(value * value) AS a, sum(value * y1) AS b, sum(value * value) AS c, sum(value * y1) AS d, sum(value * y2) AS e"))
def design_wiener(spark, sf_dir):
    return _long(design.wiener(_centred(spark, sf_dir), 2, part=LONG_PART))


_CENTRED_ONE = CENTRED.replace(SAMPLES, _ONE)


@query("design_least_squares", _prediction_sql(_CENTRED_ONE, "sum(x1 * x1) FILTER (i > 1) AS a, sum(x1 * x2) FILTER (i > 1) AS b, sum(x2 * x2) FILTER (i > 1) AS c, sum(value * x1) FILTER (i > 1) AS d, sum(value * x2) FILTER (i > 1) AS e"))
def design_least_squares(spark, sf_dir):
    """All events as one signal."""
    return _long(design.wiener(long.centred(events_as_one(spark, sf_dir)), 2, "covariance", LONG_PART))


@query("preview_spectrum", f"""WITH {_CENTRED_ONE}, bins AS (SELECT unnest(range((SELECT any_value(n) FROM x) // 2 + 1)) AS k)
SELECT k, round(k / any_value(n), 6) AS f, round(sqrt(pow(sum(value * cos(2 * pi() * ((k * i) % n) / n)), 2) + pow(sum(value * sin(2 * pi() * ((k * i) % n) / n)), 2)), 4) + 0.0 AS s FROM x, bins GROUP BY k""")
def preview_spectrum(spark, sf_dir):
    """Of all events as one signal, which no task transforms as a whole."""
    found = long_fft.spectrum(long.centred(events_as_one(spark, sf_dir)))
    return _rounded(_rounded(found.select("k", "f", "s"), "f"), "s", digits=4)


def _search_sql(values: dict[int, str]) -> str:
    """snr of each value of a parameter, with its result as SQL over ``w``."""
    parts = " UNION ALL ".join(f"SELECT signal_id, {k} AS p, value, {v} AS y FROM x WINDOW w AS ({W})" for k, v in values.items())
    return f"WITH {CENTRED}, y AS ({parts}), s AS (SELECT signal_id, p, 10 * log10(var_pop(value) / (var_pop(value - y) + 1e-10)) AS snr FROM y GROUP BY ALL)"


_AVERAGES = {w: f"sum(value) OVER ({W} ROWS BETWEEN {w // 2} PRECEDING AND {(w - 1) // 2} FOLLOWING) / {w}" for w in range(2, 10)}
_MEDIANS = {k: f"list_sort([{', '.join(_at(j) for j in range(-(k // 2), k // 2 + 1))}])[{k // 2 + 1}]" for k in range(3, 12)}
_MEDIANS = {k: _MEDIANS[k // 2 * 2 + 1] if k // 2 * 2 + 1 in _MEDIANS else _MEDIANS[k] for k in _MEDIANS}


@query("search_moving_average_scores", f"{_search_sql(_AVERAGES)} SELECT signal_id, p AS window_size, round(snr, {DIGITS}) + 0.0 AS snr FROM s")
def search_moving_average_scores(spark, sf_dir):
    """Every candidate's merit, all from one window."""
    tried = search.candidates(spark, "moving_average_filter", '{"window_size": [2, 9]}')
    found = search.judged(_centred(spark, sf_dir), "moving_average_filter", tried, LONG_PART)
    return _rounded(found.select("signal_id", (F.col("candidate") + 2).alias("window_size"), "snr"), "snr")


@query("search_median_best", f"{_search_sql(_MEDIANS)} SELECT signal_id, arg_max(p, {{'s': snr, 'p': -p}})::DOUBLE AS kernel_size, round(max(snr), {DIGITS}) + 0.0 AS snr FROM s GROUP BY signal_id")
def search_median_best(spark, sf_dir):
    """Each signal's best of nine."""
    found = search.search(_centred(spark, sf_dir), "median_filter", '{"kernel_size": [3, 11]}', 9, LONG_PART, exhaustive=True)
    return _rounded(found.select("signal_id", F.col("params")["kernel_size"].alias("kernel_size"), "snr"), "snr")


@query("metrics_time_flattened", f"WITH {_FLAT} {_FLAT_METRICS}")
def metrics_time_flattened(spark, sf_dir):
    """Per channel and, by grouping sets in the same shuffle, per signal."""
    found = moments.moments(_price_samples(spark, sf_dir), ["signal_id"], flattened=True)
    return _rounded(moments.time_metrics(found, ["signal_id", "channel"]), "value", digits=5)


@query("metrics_time_merged", f"WITH {_FLAT} {_FLAT_METRICS} WHERE channel = -1")
def metrics_time_merged(spark, sf_dir):
    """The same of whole signals, merged from moments by channel and month."""
    parts = moments.moments(_price_samples(spark, sf_dir, F.date_trunc("month", "l_shipdate").alias("month")), ["signal_id", "month"])
    found = moments.merged(parts, ["signal_id"]).withColumn("channel", F.lit(moments.WHOLE))
    return _rounded(moments.time_metrics(found, ["signal_id", "channel"]), "value", digits=5)


@query("metrics_spectrum", f"""WITH {SPECTRUM_SQL}, p AS (
  SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY s, k) AS r, count(*) OVER g AS n, sum(s) OVER g AS total, max(s) OVER g AS top, s - avg(s) OVER g AS c,
         abs(s - lag(s) OVER (PARTITION BY signal_id ORDER BY k)) AS step FROM spectrum WHERE k > 0 WINDOW g AS (PARTITION BY signal_id)),
a AS (SELECT signal_id, {_MOMENTS}, least((max(f) FILTER (s >= top / 2) - min(f) FILTER (s >= top / 2)) / max(f), 1) AS fbr, sqrt(sum(s * s)) / sum(s) AS sln,
             1 - 2 * sum((n - r + 0.5) * s) / (any_value(n) * any_value(total)) AS gi, sum(-(s / (total + 1e-12)) * log2(s / (total + 1e-12) + 1e-12)) / log2(any_value(n)) AS ese,
             stddev_pop(step) / (avg(step) + 1e-12) AS si FROM p GROUP BY signal_id)
SELECT signal_id, metric, round(value, 4) AS value FROM (SELECT signal_id, fbr, m4 / (m2 * m2) AS esk, sln, gi, ese, si FROM a) UNPIVOT (value FOR metric IN (fbr, esk, sln, gi, ese, si))""")
def metrics_spectrum(spark, sf_dir):
    return _metric_rows(metrics.spectrum_metrics(_spectra(spark, sf_dir)))


@query("metrics_match", f"""WITH {SPECTRUM_SQL}, {MATCH_SQL}, low AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY s, k) AS r, count(*) OVER (PARTITION BY signal_id) AS n FROM spectrum),
w AS (SELECT signal_id, avg(s) FILTER (f > 0) AS mean, sum(s) AS total, sqrt(avg(s * s) FILTER (r <= greatest(floor(n * 0.8), 1))) AS floor FROM low GROUP BY signal_id),
m AS (SELECT signal_id, max(amplitude) AS ffa, sum(amplitude) AS sum, sqrt(sum(amplitude * amplitude)) / sum(amplitude) AS hln FROM matches GROUP BY signal_id)
SELECT signal_id, metric, round(value, 4) AS value FROM (SELECT signal_id, ffa, ffa / mean AS rffi, 20 * log10(ffa / floor) AS lsnr, sum / total AS ffr, hln FROM m JOIN w USING (signal_id))
UNPIVOT (value FOR metric IN (ffa, rffi, lsnr, ffr, hln))""")
def metrics_match(spark, sf_dir):
    spectra = _spectra(spark, sf_dir)
    return _metric_rows(metrics.match_metrics(spectra, envelope.fault_matches(spectra, _targets(spark))))


_FREQS = ", ".join(str(v) for v in TARGETS.values())


@query("metrics_target", f"""WITH {SPECTRUM_SQL}, e AS (SELECT signal_id, s * s AS e, EXISTS (SELECT 1 FROM (SELECT unnest([{_FREQS}]) AS t) WHERE abs(f - t) <= 0.03 * t) AS near,
  EXISTS (SELECT 1 FROM (SELECT unnest([{_FREQS}]) AS t), (SELECT unnest([1, 2, 3]) AS h) WHERE abs(f - t * h) <= 0.02 * t * h) AS harmonic FROM spectrum)
SELECT signal_id, metric, round(value, 4) + 0.0 AS value FROM (SELECT signal_id, coalesce(sum(e) FILTER (near), 0) / sum(e) AS er, coalesce(sum(e) FILTER (harmonic), 0) / sum(e) AS her FROM e GROUP BY signal_id)
UNPIVOT (value FOR metric IN (er, her))""")
def metrics_target(spark, sf_dir):
    return _metric_rows(metrics.target_metrics(_spectra(spark, sf_dir), _targets(spark)))


@query("metrics_peak", f"""WITH {PEAKS_SQL}, three AS (SELECT signal_id, f AS t FROM peaks WHERE rank <= 3), five AS (SELECT signal_id, sum(a * a) AS five FROM peaks WHERE rank <= 5 GROUP BY signal_id)
SELECT signal_id, 'ser' AS metric, round(sum(CASE WHEN abs(s.f - t) <= 0.1 * t + 1e-9 THEN s.s * s.s ELSE 0 END) / any_value(five), 4) AS value
FROM spectrum s JOIN three USING (signal_id) JOIN five USING (signal_id) GROUP BY signal_id""")
def metrics_peak(spark, sf_dir):
    spectra = _spectra(spark, sf_dir)
    return _metric_rows(metrics.peak_metrics(spectra, envelope.dominant_peaks(spectra)))


#: Bins of a padded spectrum, fine enough that a peak has neighbours within five percent.
HSI_FFT = 256
_PADDED = SPECTRUM_SQL[: SPECTRUM_SQL.rindex("spectrum AS (")] + f"""spectrum AS (SELECT signal_id, k, k / {HSI_FFT} AS f,
             sqrt(pow(sum(e * cos(2 * pi() * ((k * i) % {HSI_FFT}) / {HSI_FFT})), 2) + pow(sum(e * sin(2 * pi() * ((k * i) % {HSI_FFT}) / {HSI_FFT})), 2)) AS s
             FROM (SELECT *, unnest(range({HSI_FFT} // 2 + 1)) AS k FROM c) GROUP BY signal_id, k)"""


@query("metrics_hsi", f"""WITH {PEAKS_SQL.replace(SPECTRUM_SQL, _PADDED)}, {MATCH_SQL},
peak_at AS (SELECT m.signal_id, m.name, arg_min(p.f, p.rank) AS f0, any_value(m.amplitude) AS amplitude FROM matches m JOIN peaks p ON p.signal_id = m.signal_id AND abs(p.a - m.amplitude) <= 0.1 * m.amplitude GROUP BY m.signal_id, m.name),
beside AS (SELECT t.signal_id, t.name, avg(s.s) AS mean, any_value(t.amplitude) AS amplitude FROM peak_at t JOIN spectrum s ON s.signal_id = t.signal_id AND abs(s.f - t.f0) <= 0.05 * t.f0 AND s.f <> t.f0 GROUP BY t.signal_id, t.name)
SELECT signal_id, 'hsi' AS metric, round(avg(CASE WHEN abs(mean) > 0 THEN (amplitude - mean) / mean ELSE 0 END), 4) + 0.0 AS value FROM beside GROUP BY signal_id""")
def metrics_hsi(spark, sf_dir):
    spectra = envelope.spectrum_rows(envelope.envelopes(_raw(spark, sf_dir), n_fft=HSI_FFT)).persist()
    found = metrics.peak_metrics(spectra, envelope.dominant_peaks(spectra), envelope.fault_matches(spectra, _targets(spark)))
    return _metric_rows(found.filter("metric = 'hsi'"))


@query("metrics_sk", f"""WITH {CENTRED}, w AS (SELECT *, least(256, n // 4) AS s, least(256, n // 4) - least(256, n // 4) // 2 AS hop FROM x),
sizes AS (SELECT signal_id, any_value(n) AS n, any_value(s) AS s, any_value(hop) AS hop, any_value(n + 2 * (s // 2)) AS padded FROM w GROUP BY signal_id),
frames AS (SELECT *, unnest(range((padded + ((hop - (padded - s) % hop) % hop) - s) // hop + 1)) AS frame FROM sizes),
held AS (SELECT f.signal_id, f.s, f.frame, x.i - (f.frame * f.hop - f.s // 2) AS j, x.value FROM frames f JOIN x ON x.signal_id = f.signal_id AND x.i >= f.frame * f.hop - f.s // 2 AND x.i < f.frame * f.hop - f.s // 2 + f.s),
h AS (SELECT *, value * (0.5 - 0.5 * cos(2 * pi() * j / s)) AS v FROM held),
z AS (SELECT signal_id, s, frame, k, sqrt(pow(sum(v * cos(2 * pi() * ((k * j) % s) / s)), 2) + pow(sum(v * sin(2 * pi() * ((k * j) % s) / s)), 2)) / (s / 2) AS a
      FROM (SELECT *, unnest(range(s // 2 + 1)) AS k FROM h) GROUP BY signal_id, s, frame, k),
c AS (SELECT signal_id, k, a - avg(a) OVER (PARTITION BY signal_id, k) AS c FROM z),
m AS (SELECT signal_id, k, avg(c * c) AS v, avg(c * c * c * c) AS q FROM c GROUP BY signal_id, k)
SELECT signal_id, 'sk' AS metric, round(avg(CASE WHEN v > 1e-24 THEN q / (v * v) ELSE 0 END), 4) AS value FROM m GROUP BY signal_id""")
def metrics_sk(spark, sf_dir):
    return _metric_rows(metrics.spectral_kurtosis(_raw(spark, sf_dir)))


# The slice that ranks four treatments by three metrics, all by windows and sums.
_CUT = "PARTITION BY signal_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING"
FOUR_SQL = f"""{CENTRED}, low AS (SELECT signal_id, i, min(value) OVER ({_CUT}) AS value FROM x),
four AS (
  SELECT signal_id, i, 'raw' AS algorithm_id, value FROM x
  UNION ALL SELECT signal_id, i, 'moving_average_filter', sum(value) OVER ({_CUT}) / 5 FROM x
  UNION ALL SELECT signal_id, i, 'morphological_filter', max(value) OVER ({_CUT}) FROM low
  UNION ALL SELECT x.signal_id, x.i, 'ewma_base', sum(y.value * CASE WHEN y.i = 0 THEN 1 ELSE 0.3 END * pow(0.7, x.i - y.i)) FROM x JOIN x y ON y.signal_id = x.signal_id AND y.i <= x.i GROUP BY ALL),
c AS (SELECT *, value - avg(value) OVER (PARTITION BY signal_id, algorithm_id) AS c FROM four),
m AS (SELECT signal_id, algorithm_id, avg(c * c) AS m2, avg(c * c * c * c) AS m4, max(abs(value)) AS peak, avg(abs(value)) AS mean_abs, sqrt(avg(value * value)) AS rms FROM c GROUP BY ALL),
metrics AS (SELECT signal_id, algorithm_id, metric, round(value, 6) AS value FROM (SELECT signal_id, algorithm_id, m4 / (m2 * m2) AS kurtosis, peak / rms AS cf, peak / mean_abs AS "if" FROM m)
            UNPIVOT (value FOR metric IN (kurtosis, cf, "if"))),
norms AS (SELECT *, row_number() OVER (PARTITION BY signal_id, metric ORDER BY value DESC, algorithm_id) AS place, count(*) OVER g AS n,
  CASE WHEN max(value) OVER g - min(value) OVER g < 1e-12 THEN 0.5 ELSE (value - min(value) OVER g) / (max(value) OVER g - min(value) OVER g) END AS minmax,
  CASE WHEN stddev_pop(value) OVER g < 1e-12 THEN 0.5 ELSE 1 / (1 + exp(-(value - avg(value) OVER g) / stddev_pop(value) OVER g / 3)) END AS zscore,
  value / sqrt(sum(value * value) OVER g + 1e-12) AS u FROM metrics WINDOW g AS (PARTITION BY signal_id, metric)),
ideal AS (SELECT *, max(u) OVER g AS best, min(u) OVER g AS worst FROM norms WINDOW g AS (PARTITION BY signal_id, metric))"""
WEIGHTS = {"kurtosis": 0.5, "cf": 0.3, "if": 0.2}
_WEIGHT = "CASE metric WHEN 'kurtosis' THEN 0.5 WHEN 'cf' THEN 0.3 ELSE 0.2 END"


def four_metrics(spark, sf_dir) -> DataFrame:
    """kurtosis, cf and if of the raw, averaged, opened and smoothed signals."""
    x = _centred(spark, sf_dir)
    parts = x.withColumn("algorithm_id", F.lit("raw"))
    for name in ("moving_average_filter", "morphological_filter", "ewma_base"):
        parts = parts.unionByName(NATIVE[name](x).withColumn("algorithm_id", F.lit(name)))
    found = metrics.time_metrics(parts).filter("metric != 'skewness'")
    return _rounded(found, "value").withColumn("higher_is_better", F.lit(True))


def _scored(name: str, sql: str, **how) -> None:
    @query(name, f"WITH {FOUR_SQL} SELECT signal_id, algorithm_id, round({sql}, 5) + 0.0 AS score FROM ideal GROUP BY signal_id, algorithm_id")
    def scored(spark, sf_dir):
        return _rounded(scoring.scores(four_metrics(spark, sf_dir), **how).select("signal_id", "algorithm_id", "score"), "score", digits=5)


_scored("score_weighted_minmax", f"sum({_WEIGHT} * minmax) / sum({_WEIGHT})", method="weighted_sum", normaliser="minmax", weights=WEIGHTS)
_scored("score_weighted_zscore", f"sum({_WEIGHT} * zscore) / sum({_WEIGHT})", method="weighted_sum", normaliser="zscore", weights=WEIGHTS)
_scored("score_weighted_rank", f"sum({_WEIGHT} * (place - 1) / (n - 1)) / sum({_WEIGHT})", method="weighted_sum", normaliser="rank", weights=WEIGHTS)
_scored("score_weighted_rank_desc", f"sum({_WEIGHT} * (n - place) / (n - 1)) / sum({_WEIGHT})", method="weighted_sum", normaliser="rank_desc", weights=WEIGHTS)
_scored("score_topsis", "sqrt(sum(pow(u - worst, 2))) / (sqrt(sum(pow(u - best, 2))) + sqrt(sum(pow(u - worst, 2))) + 1e-12)", method="topsis")
_scored("score_borda_count", "sum(n - place + 1) / sum(n)", method="borda_count")


@query("score_pareto", f"""WITH {FOUR_SQL}, wide AS (SELECT signal_id, algorithm_id, max(value) FILTER (metric = 'kurtosis') AS a, max(value) FILTER (metric = 'cf') AS b, max(value) FILTER (metric = 'if') AS c FROM metrics GROUP BY ALL),
d AS (SELECT w.signal_id, w.algorithm_id, count(*) FILTER (o.a >= w.a AND o.b >= w.b AND o.c >= w.c AND (o.a > w.a OR o.b > w.b OR o.c > w.c)) AS d FROM wide w JOIN wide o USING (signal_id) GROUP BY ALL)
SELECT signal_id, algorithm_id, round(1 - d / greatest(max(d) OVER (PARTITION BY signal_id), 1), 5) + 0.0 AS score FROM d""")
def score_pareto(spark, sf_dir):
    return _rounded(scoring.scores(four_metrics(spark, sf_dir), "pareto").select("signal_id", "algorithm_id", "score"), "score", digits=5)


@query("metric_ranks", f"WITH {FOUR_SQL} SELECT signal_id, algorithm_id, metric, place::INT AS metric_rank FROM norms")
def metric_ranks(spark, sf_dir):
    return scoring.metric_ranks(four_metrics(spark, sf_dir)).select("signal_id", "algorithm_id", "metric", "metric_rank")


@query("rank_treatments", f"""WITH {FOUR_SQL}, score AS (SELECT signal_id, algorithm_id, round(sum({_WEIGHT} * minmax) / sum({_WEIGHT}), 5) AS overall_score FROM norms GROUP BY signal_id, algorithm_id)
SELECT signal_id, algorithm_id, overall_score + 0.0 AS overall_score, row_number() OVER (PARTITION BY signal_id ORDER BY overall_score DESC, algorithm_id)::INT AS overall_rank FROM score""")
def rank_treatments(spark, sf_dir):
    m = four_metrics(spark, sf_dir)
    score = _rounded(scoring.scores(m, "weighted_sum", "minmax", WEIGHTS), "score", digits=5)
    return scoring.rankings(m, score).select("signal_id", "algorithm_id", "overall_score", "overall_rank")


def _twice(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two runs over the signals, kept by date: the second weighs otherwise."""
    m = written(four_metrics(spark, sf_dir), "metrics")
    folder = f"{shared_dir(spark)}/history-{uuid.uuid4().hex[:12]}"
    for day, weights in (("2024-01-01", WEIGHTS), ("2024-01-02", {"if": 1.0}), ("2024-01-02", OTHER_WEIGHTS)):  # a date written again
        history.save(scoring.rankings(m, _rounded(scoring.scores(m, "weighted_sum", "minmax", weights), "score", digits=5)), folder, day)
    return history.load(spark, folder, "2024-01-01"), history.load(spark, folder, "2024-01-02")


OTHER_WEIGHTS = {"kurtosis": 0.1, "cf": 0.1, "if": 0.8}
_OTHER = "CASE metric WHEN 'kurtosis' THEN 0.1 WHEN 'cf' THEN 0.1 ELSE 0.8 END"
_RUNS = f"""{FOUR_SQL}, """ + ", ".join(
    f"""s{k} AS (SELECT signal_id, algorithm_id, round(sum({w} * minmax) / sum({w}), 5) + 0.0 AS score FROM norms GROUP BY signal_id, algorithm_id),
r{k} AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY score DESC, algorithm_id)::INT AS rank FROM s{k})""" for k, w in ((1, _WEIGHT), (2, _OTHER)))


@query("history_changes", f"""WITH {_RUNS} SELECT signal_id, algorithm_id, 'changed' AS change, r1.rank AS old_rank, r2.rank AS new_rank, r1.score AS old_score, r2.score AS new_score
FROM r1 JOIN r2 USING (signal_id, algorithm_id) WHERE (r1.rank, r1.score) <> (r2.rank, r2.score)""")
def history_changes(spark, sf_dir):
    return history.changes(*_twice(spark, sf_dir)).drop("channel")


@query("history_unchanged", f"""WITH {_RUNS} SELECT signal_id, algorithm_id, rank AS overall_rank, score AS overall_score FROM r1 INTERSECT ALL SELECT signal_id, algorithm_id, rank, score FROM r2""")
def history_unchanged(spark, sf_dir):
    return history.unchanged(*_twice(spark, sf_dir)).drop("channel")


@query("run_log", """WITH u AS (SELECT count(DISTINCT user_id) AS n, count(*) AS rows FROM events)
SELECT 'low_pass_butterworth' AS algorithm_id, n AS rows, n AS failures FROM u UNION ALL SELECT 'ewma_base', n, 0 FROM u UNION ALL SELECT 'median_filter', n, 0 FROM u""")
def run_log(spark, sf_dir):
    """Rows and failures by operator, observed while the results are written: at rate
    1 a cut-off of 1 kHz is beyond Nyquist."""
    plan = ["low_pass_butterworth", "ewma_base", "median_filter"]
    found, log = runlog.logged(fan_out(events_as_signals(spark, sf_dir), [(o, {}) for o in plan]), plan)
    written(found, "run")
    return log.rows(spark).select("algorithm_id", "rows", "failures")


@query("metric_pivot", f"WITH {FOUR_SQL} SELECT signal_id, algorithm_id, round(max(value) FILTER (metric = 'cf'), 4) AS cf, round(max(value) FILTER (metric = 'if'), 4) AS \"if\", round(max(value) FILTER (metric = 'kurtosis'), 4) AS kurtosis FROM metrics GROUP BY ALL")
def metric_pivot(spark, sf_dir):
    wide = four_metrics(spark, sf_dir).groupBy("signal_id", "algorithm_id").pivot("metric", ["cf", "if", "kurtosis"]).agg(F.first("value"))
    return _rounded(wide, "cf", "if", "kurtosis", digits=4)


_LISTED = ", ".join(f"('{s.id}', '{s.category}', '{s.complexity}', {s.max_length if s.max_length else 'NULL'}::INT)" for s in SPECS.values())


@query("catalog_operators", f"SELECT * FROM (VALUES {_LISTED}) t(algorithm_id, category, complexity, max_signal_length)")
def catalog_operators(spark, sf_dir):
    return catalog.catalog(spark).select("algorithm_id", "category", "complexity", "max_signal_length")


@query("inventory_rollup", """SELECT event_type, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, (2 - grouping(event_type) - grouping(date_trunc('week', ts)))::INT AS level, count(*) AS samples,
  count(DISTINCT user_id) AS signals, count(*) FILTER (value IS NULL) AS missing, min(value) AS low, max(value) AS high FROM events GROUP BY ROLLUP (event_type, date_trunc('week', ts))""")
def inventory_rollup(spark, sf_dir):
    """The stored events by type and week, with totals."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"), F.col("user_id").alias("signal_id"), "value")
    return catalog.inventory(rows, ["event_type", "week"])


@query("catalog_search")
def catalog_search(spark, sf_dir):
    return catalog.tree(catalog.search(catalog.filtered(catalog.catalog(spark), ["wavelet", "emd"]), "threshold")).select("algorithm_id", "category")


@query("catalog_counts", f"SELECT category, complexity, count(*) AS operators FROM (VALUES {_LISTED}) t(algorithm_id, category, complexity, m) GROUP BY ROLLUP (category, complexity)")
def catalog_counts(spark, sf_dir):
    return catalog.counts(catalog.catalog(spark))


@query("fan_out_time_domain")
def fan_out_time_domain(spark, sf_dir):
    """Every operator of a category on every signal, in one pass."""
    signals = preprocess.preprocess(events_as_signals(spark, sf_dir))
    found = fan_out(signals, [(i, {}) for i in catalog.select_ids("category", categories=["time"])])
    return found.select(*KEYS, "algorithm_id", F.size("denoised").alias("n"), "success")


@query("pipeline_ranking")
def pipeline_ranking(spark, sf_dir):
    """All stages on the stored signals, with the time-domain operators."""
    from .plans import config

    chosen = config.merge(config.DEFAULTS, {"operators": {"mode": "category", "categories": ["time"]}, "envelope": {"manual": TARGETS}})
    found = pipeline.analyse(events_as_signals(spark, sf_dir), chosen)
    return found.rankings.select(*KEYS, "algorithm_id", F.round("overall_score", 4).alias("overall_score"), "overall_rank")


_TIME_IDS = sorted(catalog.select_ids("category", categories=["time"]))
_EACH = " UNION ALL ".join(f"SELECT '{i}' AS algorithm_id, signal_id, value FROM ({DENOISE_SQL[i].replace(f', {DIGITS})', ', 12)')})" for i in _TIME_IDS)


@query("pipeline_ranking_time", f"""WITH d AS ({_EACH}), c AS (SELECT *, value - avg(value) OVER (PARTITION BY signal_id, algorithm_id) AS c FROM d),
m AS (SELECT signal_id, algorithm_id, avg(c * c) AS m2, avg(c * c * c * c) AS m4, max(abs(value)) AS peak, avg(abs(value)) AS mean_abs, sqrt(avg(value * value)) AS rms FROM c GROUP BY ALL),
v AS (SELECT signal_id, algorithm_id, metric, value FROM (SELECT signal_id, algorithm_id, m4 / (m2 * m2) AS kurtosis, peak / rms AS cf, peak / mean_abs AS "if" FROM m) UNPIVOT (value FOR metric IN (kurtosis, cf, "if"))),
n AS (SELECT *, CASE WHEN max(value) OVER g - min(value) OVER g < 1e-12 THEN 0.5 ELSE (value - min(value) OVER g) / (max(value) OVER g - min(value) OVER g) END AS norm FROM v WINDOW g AS (PARTITION BY signal_id, metric)),
s AS (SELECT signal_id, algorithm_id, sum({_WEIGHT} * norm) / sum({_WEIGHT}) AS score FROM n GROUP BY ALL)
SELECT signal_id, algorithm_id, round(score, 4) AS overall_score, row_number() OVER (PARTITION BY signal_id ORDER BY score DESC, algorithm_id)::INT AS overall_rank FROM s""")
def pipeline_ranking_time(spark, sf_dir):
    """The pipeline's stages with the time-domain operators and metrics."""
    from .plans import config

    chosen = config.merge(config.DEFAULTS, {"operators": {"mode": "category", "categories": ["time"]}, "envelope": {"manual": TARGETS}, "metrics": {"enabled": list(WEIGHTS)}, "scoring": {"weights": WEIGHTS}})
    found = pipeline.analyse(events_as_signals(spark, sf_dir), chosen)
    return _rounded(found.rankings.select("signal_id", "algorithm_id", "overall_score", "overall_rank"), "overall_score", digits=4)


__all__ = ["ORACLE_SQL", "QUERIES", "to_array"]
