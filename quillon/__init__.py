"""A Spark-native research engine for financial time series."""
