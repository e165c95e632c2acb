"""Batch-first evidence retrieval and data processing on Spark DataFrames."""
