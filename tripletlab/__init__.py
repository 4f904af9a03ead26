"""Spark-native analytics for position-resolved sequencing profiles."""
