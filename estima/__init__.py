"""Approximate analytics on Spark: sketches as BINARY columns, built and merged by Catalyst aggregates."""

__version__ = "0.1.0"
