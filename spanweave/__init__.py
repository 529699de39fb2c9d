"""Spark-native analytics over sensitive spans, mask timelines and review ledgers."""
