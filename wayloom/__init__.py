"""Spark-native road-map inference from streams of vehicle positions."""
