"""Spark-native engine for finding, scoring and calibrating links between passages."""
