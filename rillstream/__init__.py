"""Ordered record streams, schema inference and partitioned export on Spark."""
