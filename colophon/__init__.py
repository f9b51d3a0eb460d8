"""Colophon: a PySpark-native analytics engine for bibliographic knowledge."""
