"""Structured Streaming: rows (signal_id, ts, value).

Causal operators keep a small state per signal and give each sample its result;
late data beyond the watermark is dropped by the event-time filter, rows of one
trigger are taken in (ts) order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "signal_id string, ts timestamp, value double, denoised double"


def _ewma(state: dict, x: float, alpha: float = 0.3) -> float:
    a = min(max(alpha, 0.01), 0.99)
    state["y"] = x if state.get("y") is None else a * x + (1 - a) * state["y"]
    return state["y"]


def _kalman(state: dict, z: float, process_noise: float = 1e-5, measurement_noise: float = 1e-3) -> float:
    x, v, a, b, c = state.get("s") or (z, 0.0, 1.0, 0.0, 1.0)
    x, a, b, c = x + v, a + 2 * b + c + process_noise, b + c, c + process_noise
    k, d, e = a / (a + measurement_noise), b / (a + measurement_noise), z - x
    state["s"] = (x + k * e, v + d * e, (1 - k) * a, (1 - k) * b, c - d * b)
    return state["s"][0]


def _predictor(rule):
    def step(state: dict, x: float, filter_order: int = 32, **p) -> float:
        past, w = state.get("past", []), np.array(state.get("w", [0.0] * filter_order))
        y = x
        if len(past) == filter_order:
            u = np.array(past)
            y = float(w @ u)
            w = rule(w, u, x - y, **p)
        state["past"], state["w"] = [x, *past][:filter_order], w.tolist()
        return y

    return step


STEPS = {
    "ewma_base": _ewma,
    "kalman_filter": _kalman,
    "lms_adaptive_filter": _predictor(lambda w, u, e, mu=0.01: w + 2 * mu * e * u),
    "nlms_adaptive_filter": _predictor(lambda w, u, e, mu=0.1: w + mu * e * u / (u @ u + 1e-10)),
    "leaky_lms_adaptive_filter": _predictor(lambda w, u, e, mu=0.01, gamma=0.001: (1 - mu * gamma) * w + mu * e * u),
}


def denoise_stream(samples: DataFrame, operator_id: str, params: dict | None = None, late: str = "10 minutes") -> DataFrame:
    """``samples`` with ``denoised``; append mode, state per signal."""
    step, given = STEPS[operator_id], params or {}

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        rows["denoised"] = [step(held, float(v), **given) for v in rows["value"]]
        state.update((json.dumps(held),))
        yield rows[["signal_id", "ts", "value", "denoised"]]

    marked = samples.withWatermark("ts", late)
    return marked.groupBy("signal_id").applyInPandasWithState(work, OUTPUT, "held string", "append", GroupStateTimeout.NoTimeout)


def window_levels(samples: DataFrame, size: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """rms, peak and mean of tumbling or sliding event-time windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    held = samples.withWatermark("ts", late).groupBy("signal_id", w.alias("w"))
    return held.agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.max(F.abs("value")).alias("peak"), F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n")).select(
        "signal_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rms", "peak", "mean", "n"
    )
