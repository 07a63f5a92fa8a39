"""Preprocessing, envelopes, metrics and scores over signals."""
