"""Spark-native analytics for catalogues of points on the sky and in N dimensions."""

__version__ = "0.1.0"
