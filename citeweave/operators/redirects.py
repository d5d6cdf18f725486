"""References to merged entities, and where they end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.graph import Graph
from citeweave.operators.survivors import BR_FIELDS, RA_FIELDS, coalesced_fields
from citeweave.staging import staged


def resolved(redirects: DataFrame) -> DataFrame:
    """from_uri, to_uri with chains of redirects followed to their ends, by pointer jumping.

    Rounds double the distance that a pointer covers; a cycle ends at its smallest member.
    """
    current = staged(redirects.where("from_uri <> to_uri").groupBy("from_uri").agg(F.min("to_uri").alias("to_uri")), "redirects")
    while current.join(current.select(F.col("from_uri").alias("to_uri")), "to_uri", "left_semi").limit(1).count():
        step = current.select(F.col("from_uri").alias("to_uri"), F.col("to_uri").alias("further"))
        new = staged(current.join(step, "to_uri", "left").select("from_uri", F.coalesce("further", "to_uri").alias("to_uri"), F.col("further").isNotNull().alias("moved")), "redirects")
        current = new.select("from_uri", "to_uri")
        if not new.where("moved and from_uri <> to_uri").limit(1).count():
            break
    return current.where("from_uri <> to_uri")


def rewritten(table: DataFrame, column: str, redirects: DataFrame) -> DataFrame:
    """The table with references in a column sent on to the survivors."""
    sent = redirects.select(F.col("from_uri").alias(column), F.col("to_uri").alias("_to"))
    return table.join(sent, column, "left").withColumn(column, F.coalesce("_to", column)).select(table.columns)


def drop_merged(table: DataFrame, redirects: DataFrame) -> DataFrame:
    return table.join(redirects.select(F.col("from_uri").alias("uri")), "uri", "left_anti")


def merge_entities(graph: Graph, kind: str, redirects: DataFrame, merges: list[DataFrame] | None = None) -> Graph:
    """The graph after the redirected entities of a kind have been merged: fields, edges and all triples follow.

    The redirects are also added to ``merges``, where steps gather what they merge.
    """
    if kind not in ("ra", "br", "ident"):
        raise ValueError(f"cannot merge entities of kind {kind}")
    if not redirects.limit(1).count():
        return graph
    if merges is not None:
        merges.append(redirects.select("from_uri", "to_uri"))
    if kind == "ra":
        graph = graph.with_(ra=coalesced_fields(graph.ra, redirects, RA_FIELDS), ar=rewritten(graph.ar, "held_by", redirects), ent_id=rewritten(graph.ent_id, "owner", redirects).distinct())
    elif kind == "br":
        merged = rewritten(coalesced_fields(graph.br, redirects, BR_FIELDS), "part_of", redirects)
        merged = merged.withColumn("part_of", F.when(F.col("part_of") != F.col("uri"), F.col("part_of")))
        graph = graph.with_(br=merged, br_ar=rewritten(graph.br_ar, "br", redirects).distinct(), ent_id=rewritten(graph.ent_id, "owner", redirects).distinct())
    else:
        graph = graph.with_(ident=drop_merged(graph.ident, redirects), ent_id=rewritten(graph.ent_id, "id", redirects).distinct())
    return graph.with_(triples=rewritten(rewritten(graph.triples, "o", redirects), "s", redirects).distinct())


def merge_owned_identifiers(graph: Graph, owners: DataFrame, merges: list[DataFrame] | None = None) -> Graph:
    """Identifiers that one of ``owners`` (uri) has twice, by scheme and literal, become one: the smallest uri."""
    owned = graph.ent_id.join(owners.select(F.col("uri").alias("owner")), "owner", "left_semi")
    held = owned.join(graph.ident.where("scheme is not null and literal is not null").withColumnRenamed("uri", "id"), "id")
    firsts = held.groupBy("owner", "scheme", "literal").agg(F.min("id").alias("to_uri"))
    redirects = resolved(held.join(firsts, ["owner", "scheme", "literal"]).select(F.col("id").alias("from_uri"), "to_uri"))
    return merge_entities(graph, "ident", redirects, merges)
