"""Spark-native entity resolution, deduplication, reconciliation and data-quality analytics."""
