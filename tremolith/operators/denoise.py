"""Denoising: every operator over every signal, failures kept as rows.

A kernel sees one channel at a time in Arrow batches, on the partition where the
channel lies: no shuffle.  Operators that mix channels are grouped by signal.
Failures (a cut-off beyond Nyquist, a signal too long or too short) become
``success = false`` with their message; every sample of ``denoised`` is null then, so that
no reader takes the input for a result.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import get, run
from .throttle import Throttle, map_batches

RESULT = "signal_id string, channel int, sample_rate double, algorithm_id string, params map<string,string>, denoised array<double>, execution_time double, success boolean, error_message string"


def fan_out(signals: DataFrame, operators: Iterable[tuple[str, dict]], partitions: int | None = None, throttle: Throttle | None = None, pad: bool = False, centred: bool = False) -> DataFrame:
    """Every signal through every (operator id, parameters).  The operator list
    is the caller's and small; each signal's rows are copied to it, spread over
    ``partitions`` where given, since a few signals may make much work, and run under
    ``throttle``.  With ``pad`` results shorter than their input (deconvolution) are
    filled with zeros.  ``centred`` takes each channel's mean away first, in the same
    worker."""
    listed = [(o, {k: json.dumps(v) for k, v in p.items()}) for o, p in operators]
    for o, _ in listed:
        get(o)
    plan = signals.sparkSession.createDataFrame(listed, "algorithm_id string, params map<string,string>")
    pairs = signals.select("signal_id", "channel", "sample_rate", "samples").crossJoin(F.broadcast(plan))
    if partitions:
        pairs = pairs.repartition(partitions, "signal_id", "algorithm_id")
    return map_batches(pairs, partial(_work, pad=pad, centred=centred), RESULT, throttle)


def denoise(signals: DataFrame, operator_id: str, params: dict | None = None, mix: bool = True, centred: bool = False) -> DataFrame:
    """One operator over every signal.  With ``mix``, operators that mix channels
    treat a signal's channels together (one channel alone: by delay embedding)."""
    spec = get(operator_id)
    if not (mix and spec.mixes_channels):
        return fan_out(signals, [(operator_id, params or {})], centred=centred)
    given = {k: json.dumps(v) for k, v in (params or {}).items()}

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("channel")
        began, error = time.perf_counter(), None
        given_rows = [_given(s, centred) for s in frame["samples"]]
        try:
            x = np.array(given_rows)
            y = run(operator_id, x[0] if len(x) == 1 else x, float(frame["sample_rate"].iloc[0]), params)
            rows = [y] if y.ndim == 1 else list(y)
        except Exception as e:  # noqa: BLE001  a failure is a result here
            rows, error = [[None] * len(s) for s in given_rows], f"{type(e).__name__}: {e}"
        took = time.perf_counter() - began
        return pd.DataFrame(
            {
                "signal_id": frame["signal_id"], "channel": frame["channel"], "sample_rate": frame["sample_rate"], "algorithm_id": operator_id,
                "params": [given] * len(frame), "denoised": rows, "execution_time": took, "success": error is None, "error_message": error,
            }
        )

    return signals.select("signal_id", "channel", "sample_rate", "samples").groupBy("signal_id").applyInPandas(together, RESULT)


def _given(samples, centred: bool) -> np.ndarray:
    x = np.asarray([] if samples is None else samples, float)
    return x - x.mean() if centred and len(x) else x


def _work(batches: Iterator[pa.RecordBatch], pad: bool = False, centred: bool = False) -> Iterator[pa.RecordBatch]:
    schema = None
    for whole in batches:
        for batch in (whole.slice(a, 256) for a in range(0, whole.num_rows, 256)):
            rows = batch.to_pylist()
            out, took, errors = [], [], []
            for r in rows:
                began, error = time.perf_counter(), None
                x = _given(r["samples"], centred)
                try:
                    given = {k: json.loads(v) for k, v in r["params"]}
                    with np.errstate(all="ignore"):
                        y = run(r["algorithm_id"], x, r["sample_rate"], given)
                except Exception as e:  # noqa: BLE001  a failure is a result here
                    y, error = [None] * len(x), f"{type(e).__name__}: {e}"
                if pad and len(y) != len(x):
                    y = np.concatenate((y, np.zeros(max(0, len(x) - len(y)))))[: len(x)]
                out.append(y)
                took.append(time.perf_counter() - began)
                errors.append(error)
            kind = pa.list_(pa.float64())
            schema = schema or ["signal_id", "channel", "sample_rate", "algorithm_id", "params", "denoised", "execution_time", "success", "error_message"]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("signal_id")), batch.column(batch.schema.get_field_index("channel")),
                    batch.column(batch.schema.get_field_index("sample_rate")), batch.column(batch.schema.get_field_index("algorithm_id")),
                    batch.column(batch.schema.get_field_index("params")), pa.array(out, kind), pa.array(took), pa.array([e is None for e in errors]), pa.array(errors, pa.string()),
                ],
                names=schema,
            )
