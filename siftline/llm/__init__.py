"""Operators for training-data pipelines. Nothing outside this package imports it; ``queries.py`` registers its queries."""
