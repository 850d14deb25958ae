"""Spark-native analytics for large raster object-detection workloads."""

__version__ = "0.1.0"
