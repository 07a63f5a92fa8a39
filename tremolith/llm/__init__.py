"""Operators for large-scale training-text pipelines.

Nothing else in the library imports this subpackage; it imports nothing from
the rest of the library either, so either side can be removed on its own.
"""
