"""Clusters that a caller asks to merge: checks, order, and the roles that give way."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions import vocabulary as V
from citeweave.graph import Graph
from citeweave.operators.containers import container_members, part_of_chain
from citeweave.operators.contributors import contributions
from citeweave.operators.filters import specific_types
from citeweave.operators.survivors import richest_donors
from citeweave.staging import staged

CLUSTERS = "survivor string, merged string, pos int"
#: What is wrong where a rule is broken.
BROKEN = {
    "empty": "has nothing to merge with",
    "self_merge": "cannot be merged into itself",
    "survivor_is_merged": "cannot be both survivor and merged entity",
    "merged_twice": "is already assigned to another cluster",
    "missing": "is no resource, agent or identifier here: Entity not found",
    "mixed_kinds": "mixes entity types",
    "container_types": "has incompatible types where one of both contains others",
    "identifier_values": "has a different scheme/literal, or none",
}
RANK = {"ident": 0, "ra": 1, "br": 2}


def clusters_frame(spark: SparkSession, mapping: Mapping[str, Iterable[str]]) -> DataFrame:
    """The mapping as rows, a null ``merged`` for an empty cluster. A plain string for the merged is refused."""
    rows = []
    for survivor, merged in mapping.items():
        if isinstance(merged, str):
            raise TypeError(f"Merged entities of {survivor} must be an iterable of URIs, not a string.")
        listed = list(dict.fromkeys(merged))
        rows += [(survivor, uri, pos) for pos, uri in enumerate(listed)] or [(survivor, None, 0)]
    return spark.createDataFrame(rows, CLUSTERS)


def cluster_violations(clusters: DataFrame, graph: Graph, expression: str = V.EXPRESSION) -> DataFrame:
    """cluster, rule, offender for every rule that a requested cluster breaks; none means it can be merged.

    empty, self_merge, survivor_is_merged, merged_twice, missing, mixed_kinds, container_types, identifier_values.
    """
    clusters = staged(clusters.select("survivor", "merged"), "asked")
    asked = clusters.where("merged is not null")
    survivors = clusters.select("survivor").distinct()
    named = survivors.select("survivor", F.col("survivor").alias("uri")).unionByName(asked.select("survivor", F.col("merged").alias("uri")))
    kinds = staged(named.join(graph.entities().where("kind <> 'ar'"), "uri", "left"), "kinds")
    found = []

    def broken(rule: str, rows: DataFrame, offender: str) -> None:
        found.append(rows.select(F.col("survivor").alias("cluster"), F.lit(rule).alias("rule"), F.col(offender).alias("offender")))

    broken("empty", survivors.join(asked, "survivor", "left_anti"), "survivor")
    broken("self_merge", asked.where("survivor = merged"), "merged")
    others = asked.where("survivor <> merged")
    broken("survivor_is_merged", others.join(survivors.select(F.col("survivor").alias("merged")), "merged", "left_semi"), "merged")
    twice = asked.groupBy("merged").agg(F.countDistinct("survivor").alias("n")).where("n > 1")
    broken("merged_twice", asked.join(twice, "merged", "left_semi"), "merged")
    broken("missing", kinds.where("kind is null"), "uri")
    own = kinds.where("uri = survivor and kind is not null").select("survivor", F.col("kind").alias("own")).distinct()
    broken("mixed_kinds", kinds.join(own, "survivor").where("kind <> own"), "uri")
    of_kind = lambda kind: kinds.where(F.col("kind") == kind).select("uri").distinct()
    containers = container_members(graph.br.join(of_kind("br").select(F.col("uri").alias("part_of")), "part_of", "left_semi")).withColumn("contains", F.lit(True))
    typed = staged(graph.br.join(of_kind("br"), "uri", "left_semi").select("uri", specific_types(F.col("types"), expression).alias("types")).join(containers, "uri", "left"), "typed")
    sides = others.join(typed.select(F.col("uri").alias("survivor"), F.col("types").alias("t1"), F.col("contains").alias("c1")), "survivor").join(typed.select(F.col("uri").alias("merged"), F.col("types").alias("t2"), F.col("contains").alias("c2")), "merged")
    disjoint = (F.size("t1") > 0) & (F.size("t2") > 0) & ~F.arrays_overlap("t1", "t2")
    broken("container_types", sides.where(disjoint & F.coalesce("c1", "c2", F.lit(False))), "merged")
    held = staged(graph.ident.join(of_kind("ident"), "uri", "left_semi").select("uri", "scheme", "literal"), "held")
    values = others.join(held.select(F.col("uri").alias("survivor"), F.col("scheme").alias("s1"), F.col("literal").alias("l1")), "survivor").join(held.select(F.col("uri").alias("merged"), F.col("scheme").alias("s2"), F.col("literal").alias("l2")), "merged")
    broken("identifier_values", values.where("coalesce(s1 <> s2 or l1 <> l2, true)"), "merged")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def cluster_order(clusters: DataFrame, graph: Graph) -> DataFrame:
    """cluster, rank, depth: identifiers, then agents, then resources, those with shallow containers first."""
    kinds = staged(clusters.select(F.col("survivor").alias("uri")).distinct().join(graph.entities().where(F.col("kind").isin(*RANK)), "uri"), "kinds")
    depths = part_of_chain(graph.br, kinds.where("kind = 'br'")).groupBy(F.col("br").alias("uri")).agg(F.max("depth").alias("depth"))
    rank = F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair])[F.col("kind")]
    return kinds.join(depths, "uri", "left").select(F.col("uri").alias("cluster"), rank.alias("rank"), F.coalesce("depth", F.lit(0)).alias("depth"))


def discarded_roles(graph: Graph, clusters: DataFrame) -> DataFrame:
    """br, ar of author and editor roles that give way: those of all but the survivor, or of all but the richest
    merged resource where the survivor has none of the type. clusters: survivor, merged."""
    chosen = clusters.where("merged is not null").select("survivor", F.col("merged").alias("br"))
    own = clusters.select("survivor", F.col("survivor").alias("br")).distinct()
    roles = contributions(graph).where(F.col("role_type").isin(V.AUTHOR, V.EDITOR))
    of_survivor = own.join(roles, "br").select("survivor", "role_type").distinct()
    merged = chosen.join(roles, "br")
    donors = richest_donors(merged.join(of_survivor, ["survivor", "role_type"], "left_anti").withColumnRenamed("survivor", "cluster"))
    kept = donors.select(F.col("cluster").alias("survivor"), "role_type", F.col("donor").alias("br"))
    return merged.join(kept, ["survivor", "role_type", "br"], "left_anti").select("br", "ar").distinct()
