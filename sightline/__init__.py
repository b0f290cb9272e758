"""Spark-native analytics over evidence streams: snapshots, run metrics, deliveries, discoveries and texts."""
