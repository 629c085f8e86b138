"""Quarry: a Spark-native engine for relational, text, vector, graph and spatial queries over DataFrames."""
