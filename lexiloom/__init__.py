"""Spark-native analytics for article corpora and word-guessing games."""
