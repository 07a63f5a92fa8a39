"""What every denoiser is: its kernel, its defaults and what the catalog says."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from ..errors import SignalTooLong, UnknownOperator


@dataclass(frozen=True)
class Spec:
    id: str
    category: str
    complexity: str
    tags: tuple[str, ...]
    kernel: Callable[..., np.ndarray]
    defaults: dict = field(default_factory=dict)
    max_length: int | None = None
    mixes_channels: bool = False
    seeded: bool = False


SPECS: dict[str, Spec] = {}


def operator(category: str, complexity: str, *tags: str, max_length: int | None = None, mixes_channels: bool = False, seeded: bool = False, **defaults):
    """Registers a kernel under its own name."""

    def wrap(kernel):
        name = kernel.__name__
        SPECS[name] = Spec(name, category, complexity, tags, kernel, defaults, max_length, mixes_channels, seeded)
        return kernel

    return wrap


def get(operator_id: str) -> Spec:
    try:
        return SPECS[operator_id]
    except KeyError:
        raise UnknownOperator(operator_id) from None


def run(operator_id: str, x: np.ndarray, fs: float, params: dict | None = None) -> np.ndarray:
    """One channel through one operator; later parameters win over defaults."""
    spec = get(operator_id)
    x = np.asarray(x, np.float64)
    if spec.max_length is not None and x.shape[-1] > spec.max_length:
        raise SignalTooLong(f"{operator_id}: {x.shape[-1]} samples, at most {spec.max_length}")
    return np.asarray(spec.kernel(x, fs, **(spec.defaults | (params or {}))), np.float64)
