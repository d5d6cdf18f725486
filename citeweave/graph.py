"""The graph as a set of DataFrames, and the schemas of its tables."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.staging import staged

SCHEMAS = {
    "br": "uri string, types array<string>, title string, subtitle string, pub_date string, number string, edition string, part_of string",
    "ra": "uri string, name string, given_name string, family_name string",
    "ar": "uri string, role_type string, held_by string, next string",
    "ident": "uri string, scheme string, literal string",
    "br_ar": "br string, ar string",
    "ent_id": "owner_kind string, owner string, id string",
    "triples": "s string, p string, o string, o_kind string, o_datatype string, o_lang string",
}
KINDS = ("br", "ra", "ar", "ident")


@dataclasses.dataclass(frozen=True)
class Graph:
    """Resources, agents, roles, identifiers, their edges, and all other triples. Operators return new graphs."""

    br: DataFrame
    ra: DataFrame
    ar: DataFrame
    ident: DataFrame
    br_ar: DataFrame
    ent_id: DataFrame
    triples: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, **tables: DataFrame | list) -> Graph:
        """A graph from DataFrames or rows; tables that aren't given are empty."""
        made = {}
        for name, schema in SCHEMAS.items():
            rows = tables.get(name, [])
            made[name] = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, schema)
        return cls(**made)

    def with_(self, **tables: DataFrame) -> Graph:
        return dataclasses.replace(self, **tables)

    def staged(self, since: Graph | None = None) -> Graph:
        """The same graph read back from written tables; tables that ``since`` holds too stay as they are."""
        tables = {f.name: getattr(self, f.name) for f in dataclasses.fields(self)}
        return Graph(**{n: t if since is not None and t is getattr(since, n) else staged(t, n) for n, t in tables.items()})

    def signatures(self, owner_kind: str) -> DataFrame:
        """uri, id, scheme, literal of the complete identifiers of the entities of a kind."""
        owned = self.ent_id.where(F.col("owner_kind") == owner_kind).select(F.col("owner").alias("uri"), "id")
        complete = self.ident.where("scheme is not null and literal is not null").select(F.col("uri").alias("id"), "scheme", "literal")
        return owned.join(complete, "id").select("uri", "id", "scheme", "literal")

    def entities(self) -> DataFrame:
        """kind and uri of every entity."""
        parts = [getattr(self, kind).select(F.lit(kind).alias("kind"), "uri") for kind in KINDS]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def lookup_entities(graph: Graph, uris: DataFrame) -> DataFrame:
    """uri and kind of each of ``uris``; ValueError for those that aren't in the graph."""
    found = uris.select("uri").distinct().join(graph.entities(), "uri", "left")
    if missing := found.where("kind is null").select("uri").orderBy("uri").take(3):
        raise ValueError("Entities not found: " + ", ".join(r.uri for r in missing))
    return found


def last_number(graph: Graph) -> int:
    """The greatest number that the uri of an identifier ends in; 0 if there is none."""
    return graph.ident.select(F.max(F.regexp_extract("uri", r"/(?:0[1-9]+0)?(\d+)$", 1).try_cast("long"))).first()[0] or 0
