"""Whole questions about a dataset, and the queries over the sample tables."""
