"""Spark-native analytics for long panels of financial time series."""
