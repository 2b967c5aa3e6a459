"""Spark-native analytics over versioned text corpora and their request telemetry."""
