"""Spark-native probabilistic time-series engine."""
