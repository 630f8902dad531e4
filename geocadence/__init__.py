"""Spark-native analytics for geospatial time series."""
