"""Spark-native library for announcement feeds collected from many boards."""

__version__ = "0.1.0"
