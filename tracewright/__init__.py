"""Spark-native analytics over account statements."""
