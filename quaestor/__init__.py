"""Spark-native quality analytics for free-text assessment items."""

__version__ = "0.1.0"
