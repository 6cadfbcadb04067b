"""Spark-native construction of typed, deduplicated knowledge graphs from text."""
