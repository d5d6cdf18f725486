"""Whole jobs: deduplication, enrichment, and the registered queries."""
