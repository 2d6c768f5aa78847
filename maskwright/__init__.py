"""Spark-native de-identification engine: find, code, verify and restore personal values."""

__version__ = "0.1.0"
