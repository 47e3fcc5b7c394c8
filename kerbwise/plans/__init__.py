"""Batch jobs, SQL views and the query registry."""
