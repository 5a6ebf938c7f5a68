"""Spark jobs over the evidence that web-research runs leave behind."""
