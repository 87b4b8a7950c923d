"""Spark-native posting and pipeline analytics."""
