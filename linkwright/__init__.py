"""Batch record linkage and data preparation on Spark."""
