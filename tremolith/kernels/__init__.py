"""Numpy kernels: (samples, sample rate, parameters) to samples.  No Spark here."""

from . import classic, decomposition, specialised  # noqa: F401  they register themselves
from .registry import SPECS, get, run

__all__ = ["SPECS", "get", "run"]
