"""Stages that take less of a machine: slots, priority, cores and BLAS threads.

``task_cpus`` is a resource profile of the one stage that runs the operators, so
heavy kernels get more of an executor's cores a task while scans and shuffles
around them keep their own; it needs a cluster (local mode has one pool of threads
and ignores it).  Priority, cores and BLAS threads hold within the Python workers of
that stage: cores and threads are given back after each task, while a lowered
priority stays with the worker, as only a privileged process may raise it again.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidConfig

# Priorities by name.
NICE = {"normal": 0, "below_normal": 10, "idle": 19}
_VARIABLES = ("OMP_NUM_THREADS", "MKL_NUM_THREADS", "OPENBLAS_NUM_THREADS", "NUMEXPR_NUM_THREADS", "VECLIB_MAXIMUM_THREADS")


def _openblas() -> Iterator[tuple[Callable[[], int], Callable[[int], None]]]:
    """Getter and setter of the threads of each OpenBLAS in this process."""
    try:
        with open("/proc/self/maps") as f:
            paths = {line.rsplit(" ", 1)[-1].strip() for line in f if "openblas" in line}
    except OSError:
        return
    for path in sorted(paths):
        library = ctypes.CDLL(path)
        for prefix, suffix in (("scipy_", "64_"), ("scipy_", ""), ("", "64_"), ("", "")):
            names = [f"{prefix}openblas_{verb}_num_threads{suffix}" for verb in ("get", "set")]
            if all(hasattr(library, n) for n in names):
                yield getattr(library, names[0]), getattr(library, names[1])
                break


@contextmanager
def blas_threads(n: int):
    """At most n threads for linear algebra, in this process, for a while."""
    known = {v: os.environ.get(v) for v in _VARIABLES}
    os.environ |= dict.fromkeys(_VARIABLES, str(n))
    before = [(put, get()) for get, put in _openblas()]
    for put, _ in before:
        put(n)
    try:
        yield
    finally:
        for put, old in before:
            put(old)
        for v, old in known.items():
            if old is None:
                os.environ.pop(v, None)
            else:
                os.environ[v] = old


@dataclass(frozen=True)
class Throttle:
    priority: str = "normal"
    cores: int = 0  # of a worker; 0: all
    blas: int = 1  # threads; 0: as they are
    task_cpus: int = 0  # of an executor for a task; 0: the session's

    def __post_init__(self):
        if self.priority not in NICE or min(self.cores, self.blas, self.task_cpus) < 0:
            raise InvalidConfig(f"throttle: {self}")

    def profile(self, spark: SparkSession) -> ResourceProfile | None:
        if not self.task_cpus or spark.sparkContext.master.split("[")[0] == "local":
            return None
        return self.built()

    def built(self) -> ResourceProfile:
        return ResourceProfileBuilder().require(TaskResourceRequests().cpus(self.task_cpus)).build

    @contextmanager
    def applied(self):
        cpus = os.sched_getaffinity(0) if hasattr(os, "sched_getaffinity") else None
        if os.nice(0) < NICE[self.priority]:
            os.nice(NICE[self.priority] - os.nice(0))
        if self.cores and cpus:
            os.sched_setaffinity(0, sorted(cpus)[: self.cores])
        try:
            if self.blas:
                with blas_threads(self.blas):
                    yield
            else:
                yield
        finally:
            if self.cores and cpus:
                os.sched_setaffinity(0, cpus)

    def around(self, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
        """``work`` under the throttle."""

        def limited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with self.applied():
                yield from work(batches)

        return limited


def map_batches(df: DataFrame, work, schema, throttle: Throttle | None = None) -> DataFrame:
    """``mapInArrow`` as a throttle wants it."""
    if throttle is None:
        return df.mapInArrow(work, schema)
    return df.mapInArrow(throttle.around(work), schema, profile=throttle.profile(df.sparkSession))


def workers(spark: SparkSession, most: int = 0) -> int:
    """Tasks to deal work to: the cluster's slots, ``most`` at most, and one at least."""
    slots = spark.sparkContext.defaultParallelism
    return max(1, min(most or slots, slots))
