"""Spark-native analytics for compositional bias in aligned symbol matrices."""

__version__ = "0.1.0"
