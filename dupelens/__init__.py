"""Spark-native duplicate-question analytics."""
