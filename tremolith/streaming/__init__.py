"""Causal denoisers and segments over unbounded sample streams."""

from .causal import denoise_stream, window_levels
from .ordered import denoise_ordered, drained, session_levels

__all__ = ["denoise_ordered", "denoise_stream", "drained", "session_levels", "window_levels"]
