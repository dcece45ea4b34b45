"""Corpus-scale threat scanning on Spark."""

__version__ = "0.1.0"
