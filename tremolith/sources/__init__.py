"""Where signals come from: files, tables, generators."""

from .readers import read_signals
from .tables import embeddings_as_signals, events_as_one, events_as_samples, events_as_signals, lineitem_as_samples

__all__ = ["embeddings_as_signals", "events_as_one", "events_as_samples", "events_as_signals", "lineitem_as_samples", "read_signals"]
