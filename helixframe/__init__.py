"""Spark-native scanning of sequences with position weight matrices."""

__version__ = "0.1.0"
