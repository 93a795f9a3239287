"""Spark-native visual regression analytics."""
