"""Deduplication of a whole graph: agents, then resources, then identifiers; or the clusters a caller names."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.graph import Graph, last_number, lookup_entities
from citeweave.operators.clusters import cluster_members
from citeweave.operators.containers import container_pairs, publisher_pairs
from citeweave.operators.contributors import merge_contributors, merge_roles, unlinked_order
from citeweave.operators.manual import BROKEN, cluster_order, cluster_violations, clusters_frame, discarded_roles
from citeweave.operators.provenance import delta_changes, snapshots, triple_delta, update_queries
from citeweave.operators.redirects import merge_entities, merge_owned_identifiers, resolved, rewritten
from citeweave.operators.survivors import cluster_redirects, surviving_entities
from citeweave.staging import staged

#: Who is responsible for what a step changes.
AGENT = "urn:citeweave"


def merge_agents(graph: Graph, redirects: DataFrame, similar_names: bool = False, merges: list[DataFrame] | None = None) -> Graph:
    """Merged agents' roles are repointed; contributors are deduplicated in the resources that the merge touches."""
    if not redirects.limit(1).count():
        return graph
    ends = redirects.select(F.col("from_uri").alias("held_by")).unionByName(redirects.select(F.col("to_uri").alias("held_by"))).distinct()
    touched = graph.ar.join(ends, "held_by", "left_semi").select(F.col("uri").alias("ar"))
    affected = staged(graph.br_ar.join(touched, "ar", "left_semi").select(F.col("br").alias("uri")).distinct(), "affected")
    merged = merge_entities(graph, "ra", redirects, merges)
    merged = merge_owned_identifiers(merged, redirects.select(F.col("to_uri").alias("uri")).distinct(), merges)
    return merge_contributors(merged.staged(graph), affected, similar_names, merges)


def container_redirects(graph: Graph, redirects: DataFrame) -> DataFrame:
    """Redirects of containers of merged resources.

    Each merged resource is compared with the first of its cluster, survivor first and then by uri, that has a
    container: a survivor without one takes that over before later ones are compared.
    """
    members = redirects.select(F.col("to_uri").alias("cluster"), F.col("from_uri").alias("uri"), F.lit(1).alias("place"))
    members = members.unionByName(redirects.select(F.col("to_uri").alias("cluster"), F.col("to_uri").alias("uri"), F.lit(0).alias("place")).distinct())
    held = members.join(graph.br.where("part_of is not null").select("uri"), "uri", "left_semi")
    first = held.groupBy("cluster").agg(F.min(F.struct("place", "uri"))["uri"].alias("first_br"))
    pairs = staged(held.join(first, "cluster").where("uri <> first_br").select("first_br", F.col("uri").alias("second_br")), "pairs")
    if not pairs.limit(1).count():
        return pairs.select(F.col("second_br").alias("from_uri"), F.col("first_br").alias("to_uri"))
    found = container_pairs(graph.br, graph.signatures("br"), pairs).where("merges")
    return resolved(found.select(F.col("second").alias("from_uri"), F.col("first").alias("to_uri")))


def merge_resources(graph: Graph, redirects: DataFrame, similar_names: bool = False, merges: list[DataFrame] | None = None) -> Graph:
    """Merged resources with the containers and publishers that merge with them; all redirects are added to ``merges``.

    Identifiers that containers gain may make further ones equivalent, so the containers that merged resources had are
    compared again until nothing more merges; every round merges at least one.
    """
    asked = redirects
    if not asked.limit(1).count():
        return graph
    merged_rows = staged(graph.br.join(redirects.select(F.col("from_uri").alias("uri")), "uri", "left_semi"), "merged")
    more = container_redirects(graph, asked)
    while redirects.limit(1).count() or more.limit(1).count():
        direct = redirects.unionByName(more)
        joint = resolved(direct)
        pairs = joint.select(F.col("to_uri").alias("first_br"), F.col("from_uri").alias("second_br"))
        publishers = publisher_pairs(graph, pairs).where("equivalent").select(F.col("second").alias("from_uri"), F.col("first").alias("to_uri"))
        merged = merge_roles(graph, staged(publishers, "publishers"), merges)
        merged = merge_entities(merged, "br", joint)
        if merges is not None:
            merges.append(direct.select("from_uri", "to_uri"))
        survivors = staged(joint.select(F.col("to_uri").alias("uri")).distinct(), "survivors")
        merged = merge_owned_identifiers(merged, survivors, merges).staged(graph)
        graph = merge_contributors(merged, survivors, similar_names, merges).staged(merged)
        merged_rows = staged(rewritten(merged_rows, "part_of", joint), "merged")
        redirects = redirects.limit(0)
        more = container_redirects(graph.with_(br=graph.br.unionByName(merged_rows)), asked)
    return graph


def _without_roles(graph: Graph, losing: DataFrame) -> Graph:
    """The graph without roles (br, ar); one that no resource holds any more is deleted and taken out of the order."""
    edges = staged(graph.br_ar.join(losing, ["br", "ar"], "left_anti").select("br", "ar"), "edges")
    gone = staged(losing.select("ar").distinct().join(edges, "ar", "left_anti").select(F.col("ar").alias("from_uri")), "gone")
    order = unlinked_order(graph.ar.select("uri", "next"), gone).withColumnRenamed("next", "_next")
    roles = graph.ar.join(gone.select(F.col("from_uri").alias("uri")), "uri", "left_anti").join(order, "uri")
    return graph.with_(br_ar=edges, ar=roles.select("uri", "role_type", "held_by", F.col("_next").alias("next")))


class GraphDeduplicator:
    """Merges entities that share identifiers. Every method returns nothing; ``graph`` holds the result.

    storage: a storage to save to, see sources.storage; merge_similar_named_contributors: also merge roles of one type
    whose holders' names are nearly the same; preferred_survivors: uris that survive their clusters.
    """

    def __init__(self, graph: Graph, storage=None, *, debug: bool = False, merge_similar_named_contributors: bool = False, preferred_survivors: Iterable[str] | None = None):
        self.graph, self.storage, self.debug = graph, storage, debug
        self.similar_names = merge_similar_named_contributors
        spark = graph.br.sparkSession
        self.preferred = spark.createDataFrame([(u,) for u in sorted(set(preferred_survivors or ()))], "uri string")
        #: What each step did to each entity; how its triples changed; who absorbed whom directly.
        self.provenance: DataFrame | None = None
        self.deltas: DataFrame | None = None
        self.merges: DataFrame | None = None
        self.steps = 0

    def deduplicate(self) -> None:
        self.deduplicate_responsible_agents()
        self.deduplicate_bibliographic_resources()
        self.deduplicate_identifiers()

    def deduplicate_and_save(self) -> None:
        self._storage()
        self.deduplicate()
        self.save()

    def _redirects(self, kind: str) -> DataFrame:
        clusters = staged(cluster_members(self.graph.signatures(kind)), "clusters")
        return staged(cluster_redirects(clusters, surviving_entities(clusters, getattr(self.graph, kind), kind, self.preferred)), "redirects")

    def _record(self, change: Callable[[Graph, list[DataFrame]], Graph]) -> None:
        """Take a step: the change of the graph, what it merges, and the provenance of both."""
        before, merges = self.graph, []
        if before.ident.limit(1).count():
            self._keep_numbers(before)
        after = change(before, merges).staged(before)
        self.steps += 1
        empty = before.br.select(F.col("uri").alias("from_uri"), F.col("uri").alias("to_uri")).limit(0)
        direct = staged(functools.reduce(DataFrame.unionByName, merges, empty).where("from_uri <> to_uri").groupBy("from_uri").agg(F.min("to_uri").alias("to_uri")), "merges")
        delta = staged(triple_delta(before, after), "delta")
        changes = delta_changes(delta, before, after, resolved(direct)).join(update_queries(delta), "entity", "left")
        found = staged(snapshots(changes, self.steps, AGENT), "provenance")
        self.graph = after
        step = F.lit(self.steps).alias("step")
        more = lambda held, new: new if held is None else held.unionByName(new)
        self.provenance = more(self.provenance, found)
        self.deltas = more(self.deltas, delta.select(step, "*"))
        self.merges = more(self.merges, direct.select(step, "from_uri", "to_uri", F.current_timestamp().alias("time")))

    def _keep_numbers(self, graph: Graph) -> None:
        """Stored counters learn of identifiers that may be merged, so that their numbers aren't given again."""
        counters = self.storage.counters(graph.br.sparkSession) if self.storage is not None else None
        if counters is not None:
            counters.reserve("id", self.storage.supplier_prefix, 0, last_number(graph))

    def deduplicate_responsible_agents(self) -> None:
        redirects = self._redirects("ra")
        self._record(lambda graph, merges: merge_agents(graph, redirects, self.similar_names, merges))

    def deduplicate_bibliographic_resources(self) -> None:
        redirects = self._redirects("br")
        self._record(lambda graph, merges: merge_resources(graph, redirects, self.similar_names, merges))

    def deduplicate_identifiers(self) -> None:
        """Attached identifiers of one scheme and literal become one, on every predicate that points at them."""
        attached = self.graph.signatures("br").unionByName(self.graph.signatures("ra")).select("id", "scheme", "literal").distinct()
        clusters = attached.groupBy("scheme", "literal").agg(F.min("id").alias("cluster"), F.count("*").alias("n")).where("n > 1")
        clusters = staged(attached.join(clusters, ["scheme", "literal"]).select(F.col("id").alias("uri"), "cluster"), "clusters")
        redirects = staged(cluster_redirects(clusters, surviving_entities(clusters, self.graph.ident, "ident", self.preferred)), "redirects")
        self._record(lambda graph, merges: merge_entities(graph, "ident", redirects, merges))

    def merge_clusters(self, mapping: Mapping[str, Iterable[str]]) -> None:
        """Merge exactly the given clusters, after all checks; containers may follow, nothing else is discovered."""
        spark = self.graph.br.sparkSession
        clusters = staged(clusters_frame(spark, mapping), "asked")
        if bad := cluster_violations(clusters, self.graph).orderBy("rule", "cluster", "offender").take(5):
            raise ValueError("; ".join(f"{r.rule}: {r.offender} {BROKEN[r.rule]} (cluster of {r.cluster})" for r in bad))
        kinds = lookup_entities(self.graph, clusters.select(F.col("survivor").alias("uri"))).withColumnRenamed("uri", "survivor")
        asked = clusters.where("merged is not null").join(kinds, "survivor").select("survivor", "merged", "kind")
        of = lambda kind: staged(asked.where(F.col("kind") == kind).select(F.col("merged").alias("from_uri"), F.col("survivor").alias("to_uri")), kind)
        identifiers, agents, resources = of("ident"), of("ra"), of("br")
        if identifiers.limit(1).count():
            self._record(lambda graph, merges: merge_entities(graph, "ident", identifiers, merges))
        if agents.limit(1).count():
            self._record(lambda graph, merges: merge_agents(graph, agents, self.similar_names, merges))
        depths = cluster_order(resources.select(F.col("to_uri").alias("survivor")), self.graph).select(F.col("cluster").alias("to_uri"), "depth")
        ordered = staged(resources.join(depths, "to_uri"), "ordered")
        for depth in [r.depth for r in ordered.select("depth").distinct().orderBy("depth").collect()]:  # as many as containers nest
            resources = ordered.where(F.col("depth") == depth).select("from_uri", "to_uri")
            self._refuse_deleted(resources)
            self._record(lambda graph, merges, asked=resources: self._merge_asked(graph, asked, merges))

    def _merge_asked(self, graph: Graph, redirects: DataFrame, merges: list[DataFrame]) -> Graph:
        """Asked resources merged, after the roles that give way have been taken out."""
        pairs = redirects.unionByName(container_redirects(graph, redirects)).select(F.col("to_uri").alias("survivor"), F.col("from_uri").alias("merged"))
        losing = staged(discarded_roles(graph, pairs), "losing")
        left = _without_roles(graph, losing).staged(graph) if losing.limit(1).count() else graph
        return merge_resources(left, redirects, self.similar_names, merges)

    def _refuse_deleted(self, redirects: DataFrame) -> None:
        """ValueError for members that an earlier cluster's merge has deleted, which names what absorbed them."""
        named = redirects.select("to_uri", F.col("from_uri").alias("uri")).unionByName(redirects.select("to_uri", F.col("to_uri").alias("uri")))
        gone = named.join(self.graph.br, "uri", "left_anti").select("uri", F.col("to_uri").alias("cluster")).distinct()
        if self.merges is not None:
            gone = gone.join(self.merges.select(F.col("from_uri").alias("uri"), F.col("to_uri").alias("into")), "uri", "left")
        if bad := gone.orderBy("uri", "cluster").take(5):
            cause = lambda r: f"merged into {r['into']}" if "into" in r and r["into"] else "marked for deletion"
            raise ValueError("; ".join(f"Entity {r.uri} is deleted ({cause(r)}) and cannot take part in the merge cluster of {r.cluster}" for r in bad))

    def merge_clusters_and_save(self, mapping: Mapping[str, Iterable[str]]) -> None:
        self._storage()
        self.merge_clusters(mapping)
        self.save()

    def _storage(self):
        if self.storage is None:
            raise ValueError("storage is required: give the deduplicator one before saving")
        return self.storage

    def save(self) -> None:
        modified = None if self.provenance is None else self.provenance.select(F.col("entity").alias("uri")).distinct()
        self._storage().save(self.graph, self.provenance, modified)
