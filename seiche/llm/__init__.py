"""Operators for preparing text and records for model training. Nothing else in the library imports this."""
