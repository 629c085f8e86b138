"""A SQL session over Spark: statements, catalogue, retrieval functions."""
