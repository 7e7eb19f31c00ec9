"""Operators for large-scale text and training-data pipelines. Nothing outside this folder imports it."""
