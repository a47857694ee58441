"""Tidewright: a Spark-native engine for read-only analytics and large text corpora."""
