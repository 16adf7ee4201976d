"""Ledgerloom: a PySpark-native engine for record linkage and column analytics."""

__version__ = "0.1.0"
