"""Denoisers as DataFrame operations."""

from .denoise import denoise, fan_out
from .native import NATIVE
from .throttle import Throttle

__all__ = ["NATIVE", "Throttle", "denoise", "fan_out"]
