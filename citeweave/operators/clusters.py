"""Duplicate discovery: entities that share an identifier, and what they form together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.operators.components import near_components
from citeweave.staging import staged


def _shared(signatures: DataFrame) -> DataFrame:
    """duplicate_edges(), with a row for every time that a holder is said to hold the identifier."""
    held = signatures.where("scheme is not null and literal is not null").select("uri", "scheme", "literal")
    firsts = held.groupBy("scheme", "literal").agg(F.min("uri").alias("first_uri"), F.max("uri").alias("_last")).where("first_uri <> _last")
    # hinted, as files are many times smaller than their rows: by their size alone, millions of rows would pass through the driver
    return held.join(firsts.hint("merge"), ["scheme", "literal"]).where("uri <> first_uri").select("uri", "first_uri", "scheme", "literal")


def duplicate_edges(signatures: DataFrame) -> DataFrame:
    """uri, first_uri, scheme, literal: every holder of a shared identifier with the first of its holders.

    A star around the smallest holder gives the same components as all pairs. The smallest is aggregated before it is
    joined back, so an identifier with very many holders is never gathered in one task.
    """
    return _shared(signatures).distinct()


def cluster_members(signatures: DataFrame) -> DataFrame:
    """uri, cluster (its smallest uri) for every entity with a duplicate."""
    found = near_components(_shared(signatures).select(F.col("first_uri").alias("a"), F.col("uri").alias("b")))
    return found.select(F.col("node").alias("uri"), F.col("component").alias("cluster"))


def duplicate_clusters(signatures: DataFrame) -> DataFrame:
    """uri, cluster (its smallest uri), cluster_size for every entity with a duplicate."""
    found = staged(cluster_members(signatures), "members")
    return found.join(found.groupBy("cluster").agg(F.count("*").alias("cluster_size")), "cluster").select("uri", "cluster", "cluster_size")


def identifier_groups(owned: DataFrame) -> DataFrame:
    """scheme, literal, survivor, n of attached identifiers (id, scheme, literal) that occur as several entities."""
    held = owned.where("scheme is not null and literal is not null").select("id", "scheme", "literal").distinct()
    return held.groupBy("scheme", "literal").agg(F.min("id").alias("survivor"), F.count("*").alias("n")).where("n > 1")

