"""Pipelines over DataFrames, and the registered queries with their SQL."""
