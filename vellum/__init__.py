"""Spark-native text search, link candidates and training-data operators."""
