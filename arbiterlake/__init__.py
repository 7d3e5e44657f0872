"""Spark-native operators for answer evaluation, routing and data-asset governance."""
