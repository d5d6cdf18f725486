"""Selections and classifications of entities and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions import vocabulary as V


def valid_identifiers(identifiers: DataFrame) -> DataFrame:
    """Identifiers that have both a scheme and a literal."""
    return identifiers.where("scheme is not null and literal is not null")


def supported_identifiers(identifiers: DataFrame, schemes: dict[str, str] | None = None) -> DataFrame:
    """Valid identifiers of the schemes that catalogues take, with their short names as scheme."""
    known = V.RESOURCE_SCHEMES if schemes is None else schemes
    short = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[F.col("scheme")]
    return valid_identifiers(identifiers).where(F.col("scheme").isin(*known)).withColumn("scheme", short)


def specific_types(types: Column, expression: str = V.EXPRESSION) -> Column:
    """Types without the generic one, in their order."""
    return F.filter(types, lambda t: t != expression)


def enrichable(resources: DataFrame, skipped: tuple[str, ...] = (V.ISSUE, V.VOLUME)) -> DataFrame:
    """Resources that are neither issues nor volumes."""
    return resources.where(~F.coalesce(F.arrays_overlap("types", F.array(*map(F.lit, skipped))), F.lit(False)))


def is_publisher(role_type: Column, publisher: str = V.PUBLISHER) -> Column:
    """True for the publisher role; a role without a type is no publisher."""
    return role_type.eqNullSafe(F.lit(publisher))


def classify_resource_identifiers(identifiers: DataFrame) -> DataFrame:
    """owner, doi (the last), issn and wikidata (all in order), openalex (the last); ``pos`` orders an owner's identifiers."""
    last = lambda scheme: F.max_by("literal", F.when(F.col("scheme") == scheme, F.col("pos")))
    every = lambda scheme: F.transform(F.array_sort(F.collect_list(F.when(F.col("scheme") == scheme, F.struct("pos", "literal")))), lambda s: s["literal"])
    found = valid_identifiers(identifiers).groupBy("owner").agg(
        last(V.DOI).alias("doi"), every(V.ISSN).alias("issn"), every(V.WIKIDATA).alias("wikidata"), last(V.OPENALEX).alias("openalex"), F.count_if(F.col("scheme") == V.DOI).alias("_d"), F.count_if(F.col("scheme") == V.OPENALEX).alias("_o")
    )
    return found.select("owner", F.when(F.col("_d") > 0, F.col("doi")).alias("doi"), "issn", "wikidata", F.when(F.col("_o") > 0, F.col("openalex")).alias("openalex"))


def classify_agent_identifiers(identifiers: DataFrame) -> DataFrame:
    """owner, has_orcid, has_viaf, has_wikidata and the other literals in order; a scheme counts if it contains the IRI."""
    held = lambda iri: F.coalesce(F.max(F.col("scheme").contains(iri)), F.lit(False))
    others = F.when(~F.col("scheme").contains(V.WIKIDATA), F.struct("pos", "scheme", "literal"))
    return valid_identifiers(identifiers).groupBy("owner").agg(held(V.ORCID).alias("has_orcid"), held(V.VIAF).alias("has_viaf"), held(V.WIKIDATA).alias("has_wikidata"), F.array_sort(F.collect_list(others)).alias("lookups"))


def absent(new: DataFrame, present: DataFrame) -> DataFrame:
    """New identifiers whose literal the owner doesn't have yet, whatever the scheme."""
    return new.join(present.select("owner", "literal").distinct(), ["owner", "literal"], "left_anti")
