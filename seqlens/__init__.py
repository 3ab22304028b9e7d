"""Spark-native analysis of ordered activity logs."""
