"""Spark-native text-overlap analytics."""

__version__ = "0.1.0"
