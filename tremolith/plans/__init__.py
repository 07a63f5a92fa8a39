"""Whole runs: catalog, configuration, pipeline, reports, command line."""
