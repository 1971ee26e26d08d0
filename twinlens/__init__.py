"""Pair deduplication and training-data preparation as PySpark jobs."""
