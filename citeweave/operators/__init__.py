"""Operators on graph tables: clustering, survivor choice, merging and rewriting."""
