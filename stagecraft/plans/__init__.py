"""Composed plans: the batch build and the report queries."""
