"""Spark-native analytics for gridded daily climate observations."""

__version__ = "0.1.0"
