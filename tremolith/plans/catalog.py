"""The operator catalog as a DataFrame, with filters and search."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UnknownOperator
from ..kernels import SPECS

# Categories in their order.
CATEGORIES = (
    "CLASSICAL_FILTER", "TIME_DOMAIN", "FREQ_DOMAIN", "WAVELET", "EMD", "ADAPTIVE", "SVD", "SPARSE", "BSS", "DEEP_LEARNING",
    "ROTATING_SPECIFIC", "ACOUSTIC", "ADVANCED", "OPTIMIZATION",
)
#: Time per 10,000 samples by complexity; a rough guide, measured figures win.
EXPECTED = {"LOW": "< 0.1 s", "MEDIUM": "0.1-1 s", "HIGH": "1-15 s"}
ALIASES = {"classical": "CLASSICAL_FILTER", "time": "TIME_DOMAIN", "frequency": "FREQ_DOMAIN", "rotating": "ROTATING_SPECIFIC", "dl": "DEEP_LEARNING"}


def catalog(spark: SparkSession) -> DataFrame:
    rows = [
        (s.id, "".join(w.capitalize() for w in s.id.split("_")), s.category, CATEGORIES.index(s.category), s.complexity, list(s.tags), False, s.max_length,
         {k: json.dumps(v) for k, v in s.defaults.items()}, EXPECTED[s.complexity])
        for s in SPECS.values()
    ]
    return spark.createDataFrame(
        rows, "algorithm_id string, name string, category string, category_order int, complexity string, tags array<string>, requires_gpu boolean, max_signal_length int, default_params map<string,string>, est_time string"
    )


def category_name(name: str) -> str:
    wanted = ALIASES.get(name.lower(), name.upper())
    if wanted not in CATEGORIES:
        raise UnknownOperator(f"no category {name!r}")
    return wanted


def filtered(df: DataFrame, category=None, complexity: str | None = None, tags=None, requires_gpu: bool | None = None) -> DataFrame:
    """Conjunction of the given conditions; any of several tags or categories."""
    if category is not None:
        names = [category] if isinstance(category, str) else category
        df = df.filter(F.col("category").isin(*[category_name(c) for c in names]))
    if complexity is not None:
        df = df.filter(F.col("complexity") == complexity.upper())
    if tags:
        df = df.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if requires_gpu is not None:
        df = df.filter(F.col("requires_gpu") == requires_gpu)
    return df


def search(df: DataFrame, text: str) -> DataFrame:
    """Case-insensitive: in the name or in a tag."""
    wanted = F.lit(text.lower())
    return df.filter(F.lower("name").contains(wanted) | F.exists("tags", lambda t: F.lower(t).contains(wanted)))


def tree(df: DataFrame) -> DataFrame:
    return df.orderBy("category_order", "name")


def counts(df: DataFrame) -> DataFrame:
    """Operators by category and complexity, with subtotals."""
    return df.rollup("category", "complexity").agg(F.count(F.lit(1)).alias("operators"))


def select_ids(mode: str = "all", ids=None, categories=None) -> list[str]:
    """Ids to run: all, the selected, or those of some categories."""
    if mode == "selected":
        for i in ids or []:
            if i not in SPECS:
                raise UnknownOperator(i)
        return list(ids or [])
    if mode == "category":
        wanted = {category_name(c) for c in categories or []}
        return [s.id for s in SPECS.values() if s.category in wanted]
    return list(SPECS)


def inventory(rows: DataFrame, levels: list[str], signal: str = "signal_id", value: str = "value") -> DataFrame:
    """What is stored: samples, distinct signals, missing values and the range of
    values, for every combination of ``levels`` and, by rollup, their totals (a null
    level; ``level`` says how many are given).  One shuffle of partial counts; signals
    are counted exactly."""
    given = sum((1 - F.grouping(c).cast("int") for c in levels), F.lit(0))
    found = rows.rollup(*levels).agg(
        given.alias("level"), F.count(F.lit(1)).alias("samples"), F.count_distinct(signal).alias("signals"), F.count_if(F.col(value).isNull()).alias("missing"),
        F.min(value).alias("low"), F.max(value).alias("high"),
    )
    return found.select(*levels, "level", "samples", "signals", "missing", "low", "high")
