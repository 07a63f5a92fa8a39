"""What a run did, counted on the rows as they stream by: no second pass.

:func:`logged` hangs ``observe`` metrics on a DataFrame of results; the job that
writes or counts it fills them, and :meth:`RunLog.rows` reads them: rows, failures,
seconds and the longest, by operator, and how many rows broke each expectation.
Expectations are SQL conditions on a row; one that is null is not met.  ``warn``
counts the rows that break one, ``drop`` leaves them out as well, ``fail`` ends the
job at the first.

The operators are the caller's list, so the metrics are a bounded handful; rows of
other operators, or of none, are counted under ``other``.  An empty table has a log
of zeros.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidConfig

POLICIES = ("warn", "drop", "fail")
OTHER = "other"


@dataclass(frozen=True)
class Expectation:
    name: str
    condition: str
    policy: str = "warn"

    def __post_init__(self):
        if self.policy not in POLICIES:
            raise InvalidConfig(f"unknown policy {self.policy!r}")


class RunLog:
    def __init__(self, operators: list[str], expectations: list[Expectation]):
        self.operators, self.expectations, self.observation = [*operators, OTHER], expectations, Observation()

    def found(self) -> dict:
        """The metrics; waits for the job that fills them."""
        return self.observation.get

    def rows(self, spark: SparkSession) -> DataFrame:
        """``algorithm_id, rows, failures, seconds, longest`` of operators that had rows."""
        m = self.found()
        held = [(o, m[f"n{k}"], m[f"f{k}"], float(m[f"s{k}"] or 0), float(m[f"l{k}"] or 0)) for k, o in enumerate(self.operators) if m[f"n{k}"]]
        return spark.createDataFrame(held, "algorithm_id string, rows bigint, failures bigint, seconds double, longest double")

    def broken(self, spark: SparkSession) -> DataFrame:
        """``expectation, policy, rows`` that broke it."""
        m = self.found()
        return spark.createDataFrame([(e.name, e.policy, m[f"e{k}"]) for k, e in enumerate(self.expectations)], "expectation string, policy string, rows bigint")


def logged(results: DataFrame, operators: list[str], expectations: list[Expectation] | None = None) -> tuple[DataFrame, RunLog]:
    """Results (algorithm_id, success, execution_time and others) and their log."""
    log = RunLog(list(operators), list(expectations or []))
    own = F.coalesce(F.col("algorithm_id"), F.lit(OTHER))
    own = F.when(own.isin(log.operators), own).otherwise(OTHER)
    metrics = []
    for k, o in enumerate(log.operators):
        here = own == o
        seconds = F.when(here, F.col("execution_time"))
        metrics += [
            F.count_if(here).alias(f"n{k}"), F.count_if(here & ~F.coalesce(F.col("success"), F.lit(False))).alias(f"f{k}"), F.sum(seconds).alias(f"s{k}"), F.max(seconds).alias(f"l{k}"),
        ]
    met = [F.coalesce(F.expr(e.condition), F.lit(False)) for e in log.expectations]
    metrics += [F.count_if(~c).alias(f"e{k}") for k, c in enumerate(met)]
    out = results.observe(log.observation, *metrics)
    for e, c in zip(log.expectations, met, strict=True):
        if e.policy == "drop":
            out = out.filter(c)
        elif e.policy == "fail":
            out = out.filter(F.when(c, True).otherwise(F.raise_error(F.lit(f"expectation {e.name!r} is not met"))))
    return out, log
