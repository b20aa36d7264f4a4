"""Spark-native jobs for keyed time series: parsing, as-of joins, features, windows and forecast scores."""
