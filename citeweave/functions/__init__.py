"""Scalar functions on columns, and the vocabulary."""
