"""Spark-native corpus audit engine: versions of text in, located findings and contracts out."""

__version__ = "0.1.0"
