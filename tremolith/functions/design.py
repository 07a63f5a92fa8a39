"""Linear prediction over channels of any length: the filter from sums of lagged
products.

One pass gives, for each channel, the sums r[k] of x[i] x[i + k] up to the filter's
order, and its first and last samples: a mergeable aggregate of some order numbers
a channel, whatever its length.  These are enough for the normal equations, either

*   ``autocorrelation`` (the Wiener predictor): the Toeplitz matrix of r, or
*   ``covariance`` (plain least squares over the samples that have a whole past): r
    less the products at the ends that no row of the design matrix holds.

The small system is solved in a task beside the row of sums; the data path is SQL,
with halos between parts as in :mod:`tremolith.operators.long`.  The driver sees
nothing.

A null sample counts as zero; a channel of n samples has at most n - 1 weights; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEYS, along
from ..operators.long import PART, in_parts, own_rows, with_length

METHODS = ("autocorrelation", "covariance")


def lagged_sums(samples: DataFrame, order: int, part: int = PART) -> DataFrame:
    """``signal_id, channel, n, r`` (order + 1 sums), ``head`` and ``tail`` (the
    first and last ``order`` samples)."""
    x = samples.select(*KEYS, "i", F.coalesce("value", F.lit(0.0)).alias("value"))
    parts = in_parts(with_length(x), 0, order, part)
    products = {f"p{k}": F.col("value") * (F.lead("value", k, 0.0).over(along()) if k else F.col("value")) for k in range(order + 1)}
    rows = own_rows(parts.withColumns(products), part)
    at = F.struct("i", "value")
    ends = {"head": F.collect_list(F.when(F.col("i") < order, at)), "tail": F.collect_list(F.when(F.col("i") >= F.col("n") - order, at))}
    found = rows.groupBy(*KEYS, "n").agg(F.array(*[F.sum(p) for p in products]).alias("r"), *[c.alias(k) for k, c in ends.items()])
    return found.withColumns({k: F.transform(F.array_sort(k), lambda s: s["value"]) for k in ends})


def _solve(n: int, r: np.ndarray, head: np.ndarray, tail: np.ndarray, order: int, method: str) -> np.ndarray:
    m = min(order, n - 1)
    if m < 1:
        return np.zeros(0)
    if method == "autocorrelation":
        gram, right = r[np.abs(np.subtract.outer(np.arange(m), np.arange(m)))], r[1 : m + 1]
    else:
        # c[j, k]: the sum of x[i - j] x[i - k] over i = m .. n - 1.
        c = np.empty((m + 1, m + 1))
        for k in range(m + 1):
            for j in range(k + 1):
                d = k - j
                before = sum(head[i] * head[i + d] for i in range(m - k))
                behind = sum(tail[len(tail) - n + i] * tail[len(tail) - n + i + d] for i in range(n - k, n - d))
                c[j, k] = c[k, j] = r[d] - before - behind
        gram, right = c[1:, 1:], c[1:, 0]
    return np.linalg.lstsq(gram, right, rcond=None)[0]


def predictors(samples: DataFrame, order: int = 32, method: str = "autocorrelation", part: int = PART) -> DataFrame:
    """``signal_id, channel, weights``: x[i] is near the sum of weights[k] x[i - 1 - k]."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")

    @F.pandas_udf("array<double>")
    def solved(n: pd.Series, r: pd.Series, head: pd.Series, tail: pd.Series) -> pd.Series:
        return pd.Series([_solve(int(k), np.asarray(a), np.asarray(h), np.asarray(t), order, method) for k, a, h, t in zip(n, r, head, tail, strict=True)])

    return lagged_sums(samples, order, part).select(*KEYS, solved("n", "r", "head", "tail").alias("weights"))


def predicted(samples: DataFrame, weights: DataFrame, order: int = 32, part: int = PART) -> DataFrame:
    """The samples as their past predicts them; the first stays."""
    x = samples.select(*KEYS, "i", F.coalesce("value", F.lit(0.0)).alias("value"))
    past = F.collect_list("value").over(along().rowsBetween(-order, -1))
    rows = own_rows(in_parts(x, order, 0, part).withColumn("past", past), part).join(weights, list(KEYS))
    # The nearest first; before the first sample there is nothing.
    products = F.zip_with(F.reverse("past"), "weights", lambda a, w: F.coalesce(a * w, F.lit(0.0)))
    value = F.when(F.col("i") == 0, F.col("value")).otherwise(F.aggregate(products, F.lit(0.0), lambda a, b: a + b))
    return rows.withColumn("value", value).select(*KEYS, "i", "value")


def wiener(samples: DataFrame, order: int = 32, method: str = "autocorrelation", part: int = PART) -> DataFrame:
    """The linear predictor of each channel, applied to it."""
    return predicted(samples, predictors(samples, order, method, part), order, part)
