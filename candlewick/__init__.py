"""Candlewick: a Spark-native engine for keyed daily time series."""
