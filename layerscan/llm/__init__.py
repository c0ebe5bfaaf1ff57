"""Operators for preparing training data: ten operators, their queries and the pipeline's parts."""
