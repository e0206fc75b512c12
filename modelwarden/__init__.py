"""Spark operators for the data side of running machine-learning models."""
