"""Lodestone: a PySpark-native engine for analytics over collections of scientific documents."""

__version__ = "0.1.0"
