"""Spark-native analytics over records of automated work."""
