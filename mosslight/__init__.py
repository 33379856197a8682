"""Mosslight: a Spark-native engine for hybrid retrieval over document corpora."""

__version__ = "0.1.0"
