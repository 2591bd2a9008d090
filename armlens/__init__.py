"""Spark-native analytics for LLM inference benchmark logs."""
