"""Spark-native text analytics, retrieval and corpus processing."""
