"""Spark-native analytics over captured web pages, board payloads and company sheets."""
