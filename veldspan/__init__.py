"""Spark-native preparation and measurement of training corpora."""
