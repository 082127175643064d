"""Spark-native preparation, search and evaluation of large document collections."""

__version__ = "0.1.0"
