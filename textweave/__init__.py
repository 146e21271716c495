"""Spark-native text analytics: features, scoring, time series and evaluation as DataFrame plans."""
