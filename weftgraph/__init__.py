"""Spark-native graph and hypergraph analytics."""
