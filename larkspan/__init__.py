"""Spark-native engine for confidence-weighted time-series measurements."""
