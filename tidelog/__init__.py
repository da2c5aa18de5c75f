"""Spark-native log anomaly analytics."""
