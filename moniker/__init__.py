"""Spark-native analytics for many-spelling entity names, and operators for large text corpora."""

__version__ = "0.1.0"
