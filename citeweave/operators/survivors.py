"""Which entity of a cluster survives, and what it takes over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BR_FIELDS = ("title", "subtitle", "part_of", "pub_date", "number", "edition")
RA_FIELDS = ("name", "given_name", "family_name")

# Joins are hinted: files are many times smaller than their rows, and by their size alone millions of rows would pass through the driver.


def _has(column: str) -> Column:
    return F.col(column).isNotNull().cast("int")


def resource_quality() -> dict[str, Column]:
    """What makes a resource the richer one, most important first."""
    return {
        "q_title": _has("title"), "q_date": F.coalesce(F.length("pub_date"), F.lit(0)), "q_subtitle": _has("subtitle"),
        "q_part_of": _has("part_of"), "q_number": _has("number"), "q_edition": _has("edition"), "q_types": F.coalesce(F.size("types"), F.lit(0)),
    }


def agent_quality() -> dict[str, Column]:
    lengths = [F.coalesce(F.length(c), F.lit(0)) for c in RA_FIELDS]
    return {"q_names": _has("name") + _has("given_name") + _has("family_name"), "q_length": lengths[0] + lengths[1] + lengths[2]}


def identifier_quality() -> dict[str, Column]:
    return {"q_scheme": _has("scheme"), "q_literal": _has("literal")}


QUALITY = {"br": resource_quality, "ra": agent_quality, "ident": identifier_quality}


def with_quality(entities: DataFrame, kind: str) -> DataFrame:
    """uri and the quality fields of the kind."""
    quality = QUALITY[kind]()
    return entities.select("uri", *[c.alias(name) for name, c in quality.items()])


def conflicting_preferences(clusters: DataFrame, preferred: DataFrame) -> DataFrame:
    """Clusters with several preferred survivors."""
    chosen = clusters.join(preferred.select("uri").distinct(), "uri", "left_semi")
    return chosen.groupBy("cluster").agg(F.count("*").alias("n_preferred")).where("n_preferred > 1")


def surviving_entities(clusters: DataFrame, entities: DataFrame, kind: str, preferred: DataFrame | None = None) -> DataFrame:
    """cluster, survivor: the preferred one, else the best quality, else the smallest uri.

    One aggregation by a struct, so clusters of any size are reduced before they are shuffled. Several preferred
    survivors in a cluster are refused before anything is merged.
    """
    ranked = clusters.select("uri", "cluster").join(with_quality(entities, kind).hint("merge"), "uri")
    first = F.lit(1)
    if preferred is not None:
        if bad := conflicting_preferences(clusters, preferred).orderBy("cluster").take(3):
            raise ValueError("Conflicting preferred survivors, several in the cluster of " + ", ".join(r.cluster for r in bad))
        ranked = ranked.join(preferred.select("uri", F.lit(0).alias("_first")).distinct(), "uri", "left")
        first = F.coalesce("_first", F.lit(1))
    order = F.struct(first.alias("first"), *[(-F.col(c)).alias(c) for c in QUALITY[kind]()], F.col("uri"))
    return ranked.groupBy("cluster").agg(F.min(order)["uri"].alias("survivor"))


def cluster_redirects(clusters: DataFrame, survivors: DataFrame) -> DataFrame:
    """from_uri, to_uri of every merged entity."""
    return clusters.join(survivors.hint("merge"), "cluster").where("uri <> survivor").select(F.col("uri").alias("from_uri"), F.col("survivor").alias("to_uri"))


def coalesced_fields(entities: DataFrame, redirects: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The survivors with each field from themselves or the first merged entity, by uri, that has it; types are united."""
    moved = entities.join(redirects.select(F.col("from_uri").alias("uri"), "to_uri").hint("merge"), "uri", "left")
    rank = F.struct(F.col("to_uri").isNotNull().alias("merged"), F.col("uri").alias("uri"))
    target = moved.withColumn("_to", F.coalesce("to_uri", "uri")).withColumn("_rank", rank)
    picked = [F.min(F.when(F.col(f).isNotNull(), F.struct("_rank", F.col(f).alias("v"))))["v"].alias(f) for f in fields]
    if "types" in entities.columns:
        picked.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"))
    return target.groupBy(F.col("_to").alias("uri")).agg(*picked).select(entities.columns)


def richest_donors(roles: DataFrame) -> DataFrame:
    """cluster, role_type, donor: the resource with the most roles of the type, then the smallest uri.

    roles: cluster, br, role_type, one row per role.
    """
    counted = roles.groupBy("cluster", "role_type", "br").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("br").alias("br")))
    return counted.groupBy("cluster", "role_type").agg(best["br"].alias("donor"))
