"""Spark-native analytics for high-rate touch and nerve recordings."""

__version__ = "0.1.0"
