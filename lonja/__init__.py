"""Lonja: a PySpark-native analytics engine for retail and wholesale trade data."""
