"""Pipelines that chain operators, and the query catalogue."""
