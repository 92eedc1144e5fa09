"""Tidewatt: a PySpark-native analytics engine for energy time series."""
