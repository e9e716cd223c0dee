"""Loomwright: a PySpark-native engine for labelled text corpora."""

__version__ = "0.1.0"
