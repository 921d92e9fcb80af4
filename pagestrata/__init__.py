"""Spark-native analytics over versioned collections of documentation pages."""

__version__ = "0.1.0"
