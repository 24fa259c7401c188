"""Symgrove: a Spark-native engine for code-graph analytics."""
