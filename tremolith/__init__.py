"""Signal analytics on Spark: denoising, envelopes, metrics and rankings as DataFrames."""
