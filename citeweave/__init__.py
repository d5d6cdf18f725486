"""Bibliographic knowledge-graph enrichment and entity resolution on Spark DataFrames."""
