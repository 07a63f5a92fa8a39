"""Signals too long for one task: numbered, cut into parts, filtered part by part.

A window over (signal_id, channel) puts a whole channel on one task.  Here a channel
is cut by sample number into parts of PART rows, each a task's work:

*   :func:`numbered` counts the rows of each key in some order by range partitions
    and their sizes, so no task sees a whole key.
*   :func:`in_parts` is the halo exchange: a part also gets the rows within reach
    on either side, copied from its neighbours (edge rows only), and the window
    operators run on parts as if these were signals; halo rows are dropped after.
*   :func:`centred`, :func:`scaled` and :func:`local_wiener` need one number for a
    channel: a grouped aggregate, joined back.
*   :func:`scanned` runs recursive filters: a part's effect on the state is affine, so
    parts are summed up on their own, the states between parts follow from these
    sums alone, and each part is then filtered from its own start.

Results equal those of the windows over whole channels.  Sample numbers ``i`` are
dense from 0.  Null values and ties are as in the window operators; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import classic
from ..model import KEYS
from ..shared import written
from .native import NATIVE, OUT, mirrored, wiener_moments, wiener_value

#: Rows of a part; its halo comes on top.
PART = 1 << 18


def numbered(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Adds ``i``: the place of each row among its keys' rows, from 0; nulls first.
    Rows that tie in ``order`` stand in any order, fixed once it is written."""
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    dealt = written(dealt, "numbered")  # read twice: ranges must not be drawn again
    part = F.shiftright("_at", 33)
    counts = dealt.groupBy(*keys, part.alias("_part")).agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of a key
    counts = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low")).alias("_shift"))
    same = part == F.col("_part")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return dealt.join(counts, same).withColumn("i", F.col("_at") + F.col("_shift")).select(*rows.columns, "i")


def _joined(samples: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each channel brought back to its samples: broadcast by Spark if
    small, else a join whose hot channels adaptive execution may split."""
    return samples.join(found, list(KEYS))


def with_length(samples: DataFrame) -> DataFrame:
    return _joined(samples, samples.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")))


def centred(samples: DataFrame) -> DataFrame:
    mean = samples.groupBy(*KEYS).agg(F.avg("value").alias("mean"))
    return _joined(samples, mean).withColumn("value", F.col("value") - F.col("mean")).select(*OUT)


def scaled(samples: DataFrame) -> DataFrame:
    spread = F.when(F.col("d") < 1e-12, 1.0).otherwise(F.col("d"))
    found = samples.groupBy(*KEYS).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("d"))
    return _joined(samples, found).withColumn("value", (F.col("value") - F.col("mean")) / spread).select(*OUT)


def in_parts(samples: DataFrame, before: int, after: int, part: int = PART) -> DataFrame:
    """The samples with ``signal_id`` as (signal_id, part), in each part that reaches
    them: ``before`` rows ahead of its first, ``after`` rows behind its last."""
    i = F.col("i")
    first, last = F.greatest(F.floor((i - after) / part), F.lit(0)), F.greatest(F.floor((i + before) / part), F.lit(0))
    reached = samples.withColumn("part", F.explode(F.sequence(first, last)))
    return reached.withColumn("signal_id", F.struct("signal_id", "part")).drop("part")


def own_rows(parts: DataFrame, part: int = PART) -> DataFrame:
    """Without halo rows, under the signals' names."""
    own = F.floor(F.col("i") / part) == F.col("signal_id.part")
    return parts.filter(own).withColumn("signal_id", F.col("signal_id.signal_id"))


def reach(operator_id: str, params: dict) -> tuple[int, int]:
    """Rows before and after a sample that its result depends on."""
    if operator_id in ("moving_average_filter", "weighted_moving_average"):
        w = params.get("window_size", 5)
        return w // 2, w - 1 - w // 2
    if operator_id == "median_filter":
        return (params.get("kernel_size", 5) // 2,) * 2
    if operator_id == "savitzky_golay_filter":
        w = max(params.get("window_length", 11), params.get("polyorder", 3) + 2)
        return (w + 1 - w % 2 - 1,) * 2
    if operator_id == "gaussian_filter":
        return (len(classic.gaussian_weights(params.get("sigma", 2.0))) // 2,) * 2
    if operator_id == "adaptive_median_filter":
        return (classic.odd_windows(params.get("initial_window_size", 3), params.get("max_window_size", 15))[1] // 2,) * 2
    if operator_id == "morphological_filter":
        return (params.get("window_size", 5) // 2 * (4 if params.get("operation") == "occo" else 2),) * 2
    raise KeyError(f"{operator_id} has no bounded reach")


def filtered(samples: DataFrame, operator_id: str, part: int = PART, **params) -> DataFrame:
    """A native operator over channels of any length."""
    if operator_id in SCANS:
        return scanned(samples, operator_id, part, **params)
    if operator_id in ("dncnn_denoise", "tcn_lstm_denoise"):
        return local_wiener(samples, 5 if operator_id == "dncnn_denoise" else 7, part)
    before, after = reach(operator_id, params)
    if operator_id in ("savitzky_golay_filter", "gaussian_filter", "adaptive_median_filter"):
        samples = with_length(samples)  # what they do at the ends
    if operator_id == "gaussian_filter":
        samples = mirrored(samples, before)
    found = NATIVE[operator_id](in_parts(samples, before, after, part), **params)
    return own_rows(found, part).select(*OUT)


def local_wiener(samples: DataFrame, size: int, part: int = PART) -> DataFrame:
    found = own_rows(wiener_moments(in_parts(samples, size // 2, (size - 1) // 2, part), size), part)
    noise = found.groupBy(*KEYS).agg(F.avg("v").alias("noise"))
    return _joined(found, noise).withColumn("value", wiener_value()).select(*OUT)


class _Ewma:
    """y' = a x + (1 - a) y: the state is y, at first the first sample."""

    def __init__(self, alpha: float = 0.3):
        self.a = min(max(alpha, 0.01), 0.99)

    def first(self, x: float) -> list[float]:
        return [x]

    def run(self, x: np.ndarray, start: int, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, y, out = self.a, float(state[0]), np.empty(len(x))
        for k, v in enumerate(x.tolist()):
            y = a * v + (1 - a) * y
            out[k] = y
        return out, np.array([y])

    def slope(self, n: int, start: int) -> np.ndarray:
        return np.array([[(1 - self.a) ** n]])


class _Kalman:
    """Position and speed; the gains depend on the sample's number alone and soon
    repeat themselves exactly, so those of any part are found in a few steps."""

    def __init__(self, process_noise: float = 1e-5, measurement_noise: float = 1e-3):
        self.q, self.r = process_noise, measurement_noise

    def first(self, x: float) -> list[float]:
        return [x, 0.0]

    def gains(self, start: int) -> Iterator[tuple[float, float]]:
        c, i, last = (1.0, 0.0, 1.0), 0, None
        while i < start and c != last:
            last, c, i = c, self._next(c)[1], i + 1
        while True:
            gain, c = self._next(c)
            yield gain

    def _next(self, c: tuple[float, float, float]) -> tuple[tuple[float, float], tuple[float, float, float]]:
        a, b, d = c[0] + 2 * c[1] + c[2] + self.q, c[1] + c[2], c[2] + self.q
        k, m = a / (a + self.r), b / (a + self.r)
        return (k, m), ((1 - k) * a, (1 - k) * b, d - m * b)

    def run(self, x: np.ndarray, start: int, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (p, v), out = state.tolist(), np.empty(len(x))
        for j, (z, (k, m)) in enumerate(zip(x.tolist(), self.gains(start), strict=False)):
            e = z - p - v
            p, v = p + v + k * e, v + m * e
            out[j] = p
        return out, np.array([p, v])

    def slope(self, n: int, start: int) -> np.ndarray:
        """What a part makes of its start, by what it makes of two starts and none."""
        zero = np.zeros(n)
        return np.stack([self.run(zero, start, e)[1] for e in np.eye(2)], axis=1)


SCANS: dict[str, Callable] = {"ewma_base": _Ewma, "kalman_filter": _Kalman}
_ARRAYS = "signal_id string, channel int, part bigint"


def scanned(samples: DataFrame, operator_id: str, part: int = PART, **params) -> DataFrame:
    """A recursive filter over channels of any length; null values count as NaN."""
    rule = SCANS[operator_id](**params)

    def columns(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for p, x in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
            yield p * part, x.values.to_numpy(zero_copy_only=False).astype(float)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, slope, first = [], [], []
            for start, x in columns(batch):
                state = np.array(rule.first(x[0]))
                first.append(state.tolist())
                rest.append(rule.run(x, start, np.zeros(len(state)))[1].tolist())
                slope.append(rule.slope(len(x), start).ravel().tolist())
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(first, kind), pa.array(rest, kind), pa.array(slope, kind)], names=["signal_id", "channel", "part", "first", "rest", "slope"])

    def followed(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("part")
        state, starts = np.asarray(parts["first"].iloc[0]), []
        for rest, slope in zip(parts["rest"], parts["slope"], strict=True):
            starts.append(state)
            state = np.asarray(rest) + np.asarray(slope).reshape(len(state), -1) @ state
        return pd.DataFrame({"signal_id": parts["signal_id"], "channel": parts["channel"], "part": parts["part"], "state": starts})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [rule.run(x, start, np.array(s.as_py(), float))[0] for (start, x), s in zip(columns(batch), batch.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.float64()))], names=["signal_id", "channel", "part", "out"])

    at = F.struct("i", F.coalesce("value", F.lit(math.nan)).alias("value"))
    held = samples.groupBy(*KEYS, F.floor(F.col("i") / part).alias("part")).agg(F.array_sort(F.collect_list(at)).alias("held"))
    arrays = held.select(*KEYS, "part", F.transform("held", lambda s: s["value"]).alias("x"))
    sums = arrays.mapInArrow(summed, f"{_ARRAYS}, first array<double>, rest array<double>, slope array<double>")
    # One row for each part of a channel, not its samples.
    starts = sums.groupBy(*KEYS).applyInPandas(followed, f"{_ARRAYS}, state array<double>")
    found = arrays.join(starts, [*KEYS, "part"]).mapInArrow(run, f"{_ARRAYS}, out array<double>")
    found = found.select(*KEYS, "part", F.posexplode("out").alias("k", "value"))
    return found.withColumn("i", F.col("part") * part + F.col("k")).select(*OUT)
