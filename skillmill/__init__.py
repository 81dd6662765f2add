"""Spark-native document skill analytics."""
