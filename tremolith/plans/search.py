"""Search of a window operator's parameters, per channel, by successive halving.

``param_bounds`` is JSON, ``{"window_size": [2, 12]}``: each name's range is cut into
``steps`` even values (whole ones where the default is whole), and the candidates are
all their combinations.  A candidate's merit is that of the searcher:
10 log10(var(x) / (var(x - y) + 1e-10)), the one with the largest stays, of equals
the first.

All candidates of a channel are judged in one pass: one window gathers a sample's
neighbours as far as the widest candidate reaches, and an array expression gives
every candidate's value from them.  Rounds judge the survivors on ETA times as
many samples each (from the start of a channel), keep a share 1 / ETA, and end with
all samples; ``exhaustive`` judges all candidates on all samples at once.

Long channels are cut into parts with halos, as in :mod:`tremolith.operators.long`.
Null samples count in no variance; a channel that doesn't vary has the merit -inf
and so the first candidate; channels of nulls alone have no best; an empty table
gives an empty result.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidConfig
from ..kernels import classic, get
from ..model import KEYS, along
from ..operators.long import PART, in_parts, own_rows, reach
from ..shared import written

#: How much more each round judges, and the samples that the first one has at least.
ETA, LEAST = 3, 32
#: Operators whose value is a weighted sum, or the middle, of neighbours.
LINEAR, MIDDLE = ("moving_average_filter", "weighted_moving_average"), ("median_filter",)


def bounds_of(spark: SparkSession, param_bounds: str) -> DataFrame:
    """``name, low, high`` of a JSON of bounds; what is none is an error."""
    read = F.from_json(F.lit(param_bounds), "map<string,array<double>>")
    found = spark.range(1).select(read.alias("b")).select(F.explode_outer("b").alias("name", "b"))
    return found.select("name", F.element_at("b", 1).alias("low"), F.try_element_at("b", F.lit(2)).alias("high"))


def candidates(spark: SparkSession, operator_id: str, param_bounds: str, steps: int = 8) -> list[dict]:
    """The grid within the bounds, a caller's handful, in order."""
    defaults, axes = get(operator_id).defaults, {}
    for r in bounds_of(spark, param_bounds).collect():  # one row a parameter
        if r["name"] is None or r["name"] not in defaults or r["low"] is None or r["high"] is None or r["low"] > r["high"]:
            raise InvalidConfig(f"bounds of {operator_id}: {param_bounds}")
        values = [r["low"] + (r["high"] - r["low"]) * k / max(1, steps - 1) for k in range(steps)]
        whole = isinstance(defaults[r["name"]], int)
        axes[r["name"]] = sorted({int(round(v)) if whole else v for v in values})
    return [dict(zip(axes, chosen, strict=True)) for chosen in itertools.product(*axes.values())]


def _weights(operator_id: str, params: dict) -> tuple[list[float], int]:
    """The weights of a candidate and how many of them stand before the sample."""
    given = get(operator_id).defaults | params
    w = int(given["window_size"])
    if operator_id == "moving_average_filter":
        return [1 / w] * w if w > 1 else [1.0], w // 2 if w > 1 else 0
    weights = [float(v) for v in classic.weight_shape(given["weight_type"], w)[::-1]]
    return weights, len(weights) // 2


def _window(operator_id: str, params: dict):
    """What a candidate's value depends on."""
    if operator_id in MIDDLE:
        return int((get(operator_id).defaults | params)["kernel_size"]) // 2
    weights, before = _weights(operator_id, params)
    return tuple(weights), before


def _value(near: Column, r: int, operator_id: str, params: dict) -> Column:
    if operator_id in MIDDLE:
        half = int((get(operator_id).defaults | params)["kernel_size"]) // 2
        return F.element_at(F.array_sort(F.slice(near, r - half + 1, 2 * half + 1)), half + 1)
    weights, before = _weights(operator_id, params)
    own = F.slice(near, r - before + 1, len(weights))
    if len(set(weights)) == 1:
        return F.aggregate(own, F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0))) * weights[0]
    products = F.zip_with(own, F.array(*[F.lit(w) for w in weights]), lambda a, w: a * w)
    return F.aggregate(products, F.lit(0.0), lambda a, b: a + b)


def judged(samples: DataFrame, operator_id: str, tried: list[dict], part: int = PART, share: float = 1.0, alive: DataFrame | None = None) -> DataFrame:
    """``signal_id, channel, candidate, snr`` of the candidates (all, or of each
    channel those of ``alive``) on a share of every channel's samples."""
    if operator_id not in LINEAR + MIDDLE:
        raise InvalidConfig(f"{operator_id} is not a window whose candidates can be judged together")
    r = max(max(reach(operator_id, get(operator_id).defaults | p)) for p in tried)
    if share < 1 or alive is not None:
        n = samples.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
        n = n if alive is None else n.join(alive.groupBy(*KEYS).agg(F.collect_list("candidate").alias("alive")), list(KEYS))
        samples = samples.join(n, list(KEYS)).filter(F.col("i") < F.greatest(F.ceil(F.col("n") * share), F.lit(LEAST)))
    parts = in_parts(samples, r, r, part)
    held = F.collect_list(F.struct("i", "value")).over(along().rowsBetween(-r, r))
    # Beyond the ends of a channel there are zeros; sample numbers are dense.
    first = F.element_at("held", 1)["i"]
    near = F.transform("held", lambda s: s["value"])
    near = F.concat(F.array_repeat(F.lit(0.0), (first - (F.col("i") - r)).cast("int")), near)
    near = F.concat(near, F.array_repeat(F.lit(0.0), F.lit(2 * r + 1) - F.size(near)))
    found = own_rows(parts.withColumn("held", held), part).withColumn("near", near)
    # Candidates of one window are judged once: sums in two orders would differ in their
    # last digits, and the first of equals would not stay.
    same: dict[object, list[int]] = {}
    for k, p in enumerate(tried):
        same.setdefault(_window(operator_id, p), []).append(k)
    values = [(F.array(*map(F.lit, ks)), _value(F.col("near"), r, operator_id, tried[ks[0]])) for ks in same.values()]
    if alive is not None:
        values = [(F.array_intersect(ks, "alive"), y) for ks, y in values]
    values = F.array(*[F.struct(ks.alias("candidates"), y.alias("y")) for ks, y in values])
    if alive is not None:
        values = F.filter(values, lambda v: F.size(v["candidates"]) > 0)
    each = found.select(*KEYS, "value", F.explode(values).alias("v")).select(*KEYS, "value", "v.candidates", "v.y")
    var = F.var_pop("value")
    snr = F.when(var == 0, -math.inf).otherwise(10 * F.log10(var / (F.var_pop(F.col("value") - F.col("y")) + 1e-10)))
    judged = each.groupBy(*KEYS, "candidates").agg(snr.alias("snr"))
    return judged.select(*KEYS, F.explode("candidates").alias("candidate"), "snr")


def _ordered() -> Column:
    """Larger for better, of equals for the first."""
    return F.struct(F.coalesce("snr", F.lit(-math.inf)), -F.col("candidate"))


def search(samples: DataFrame, operator_id: str, param_bounds: str, steps: int = 8, part: int = PART, exhaustive: bool = False, least: int | None = None) -> DataFrame:
    """``signal_id, channel, params, snr``: the best candidate of each channel."""
    spark = samples.sparkSession
    tried = candidates(spark, operator_id, param_bounds, steps)
    rounds = 0 if exhaustive or len(tried) < 2 else math.ceil(math.log(len(tried), ETA)) - 1
    alive, left = None, len(tried)
    for k in range(rounds, 0, -1):
        found = judged(samples, operator_id, tried, part, float(ETA) ** -k, alive)
        left = max(least or 1, -(-left // ETA))
        # At most as many structs as there are candidates.
        best = found.groupBy(*KEYS).agg(F.slice(F.sort_array(F.collect_list(_ordered()), asc=False), 1, left).alias("best"))
        alive = written(best.select(*KEYS, F.explode("best").alias("b")).select(*KEYS, (-F.col("b.col2")).alias("candidate")), "alive")
    found = judged(samples, operator_id, tried, part, 1.0, alive)
    best = found.groupBy(*KEYS).agg(F.max_by("candidate", _ordered()).alias("candidate"), F.max("snr").alias("snr")).filter("snr IS NOT NULL")
    listed = spark.createDataFrame([(k, {n: float(v) for n, v in p.items()}) for k, p in enumerate(tried)], "candidate int, params map<string,double>")
    return best.join(F.broadcast(listed), "candidate").select(*KEYS, "params", "snr")
