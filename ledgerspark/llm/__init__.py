"""Operators for training-data pipelines, their registered queries and their expected results in SQL."""
