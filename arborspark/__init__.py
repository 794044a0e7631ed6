"""Spark-native engine for mutation-annotated trees."""
