"""Enrichment: missing identifiers of resources and of their authors and publishers, from catalogue lookups.

The steps are joins with lookups in the order in which their answers feed each other. Within a step requests are
staged by position, so that a later identifier of an owner is only asked when no earlier one had an answer.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from citeweave.functions import vocabulary as V
from citeweave.functions.text import orcid_search, usable_title
from citeweave.graph import Graph, last_number
from citeweave.operators import filters
from citeweave.operators.contributors import contributions
from citeweave.operators.provenance import delta_changes, snapshots, triple_delta, update_queries
from citeweave.sources import lookups as L
from citeweave.sources.counters import MemoryCounters
from citeweave.staging import staged

NEW = "owner_kind string, owner string, scheme string, literal string"
NUMBERED = f"{NEW}, id string"
#: Who is responsible for what is added.
AGENT = "urn:citeweave"


def numbered_identifiers(graph: Graph, new: DataFrame, base: str, counters=None, prefix: str = "") -> DataFrame:
    """owner_kind, owner, scheme, literal, id of new identifiers (owner_kind, owner, scheme, literal) that their owners lack,
    whatever the scheme.

    Each gets the next free number, of those that ``counters`` give, else above all of the graph; numbers follow the order
    of owner, scheme and literal, counted by partition so that no task orders them all.
    """
    held = graph.ent_id.join(graph.ident.select(F.col("uri").alias("id"), "literal"), "id").select("owner", "literal")
    fresh = filters.absent(new.dropDuplicates(["owner", "literal"]), held)
    spread = staged(fresh.repartitionByRange("owner", "scheme", "literal").sortWithinPartitions("owner", "scheme", "literal").withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "fresh")
    count = spread.count()
    first = (counters or MemoryCounters()).reserve("id", prefix, count, last_number(graph)) if count else 0
    sizes = spread.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    # one row per partition, not per identifier
    offsets = sizes.select("part", "first", (F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + first).alias("start"))
    number = (F.col("start") + F.col("row") - F.col("first")).cast("string")
    return staged(spread.join(offsets, "part").select("owner_kind", "owner", "scheme", "literal", F.concat(F.lit(base), number).alias("id")), "numbered")


def with_identifiers(graph: Graph, numbered: DataFrame) -> Graph:
    """The graph with numbered identifiers and their owners' edges to them."""
    return graph.with_(
        ident=graph.ident.unionByName(numbered.select(F.col("id").alias("uri"), "scheme", "literal")),
        ent_id=graph.ent_id.unionByName(numbered.select("owner_kind", "owner", "id")),
    )


def added_identifiers(graph: Graph, new: DataFrame, base: str, counters=None) -> Graph:
    """The graph with the new identifiers (owner_kind, owner, scheme, literal) that their owners lack."""
    return with_identifiers(graph, numbered_identifiers(graph, new, base, counters))


def first_found(asked: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """owner, pos, literal: what a search finds for each owner's first request for which it finds anything.

    asked: owner, pos (from 1, without gaps) and what the search needs; search: requests -> owner, pos, literal. Owners
    without a find ask again with as many requests as all their rounds before and one more, so requests after a find are
    few, and rounds grow with the logarithm of an owner's requests.
    """
    left, found, upto = staged(asked, "asked"), None, 1
    while left.where(F.col("pos") <= upto).limit(1).count():
        hits = staged(search(left.where(F.col("pos") <= upto)).groupBy("owner").agg(F.min(F.struct("pos", "literal")).alias("h")).select("owner", "h.pos", "h.literal"), "hits")
        found = hits if found is None else found.unionByName(hits)
        left = staged(left.where(F.col("pos") > upto).join(hits.select("owner"), "owner", "left_anti"), "asked")
        upto = 2 * upto + 1
    return found if found is not None else left.select("owner", "pos", F.lit(None).cast("string").alias("literal"))


def first_answers(provider: L.LookupProvider, requests: DataFrame, source: str, op: str) -> DataFrame:
    """owner, pos, key, body of each owner's first request (owner, pos, key) with an answer; later ones aren't asked."""
    left, found = staged(requests, "requests"), None
    while left.limit(1).count():
        now = left.groupBy("owner").agg(F.min(F.struct("pos", "key")).alias("r")).select("owner", "r.pos", "r.key")
        answered = staged(L.lookup(provider, now, source, op).select("owner", "pos", "key", "body"), "answers")
        found = answered if found is None else found.unionByName(answered)
        left = staged(left.join(now.select("owner", "pos"), ["owner", "pos"], "left_anti").join(answered.select("owner"), "owner", "left_anti"), "requests")
    return found if found is not None else left.select("owner", "pos", "key", F.lit(None).cast("string").alias("body"))


def ordered_identifiers(graph: Graph, owner_kind: str) -> DataFrame:
    """owner, pos, scheme, literal: an owner's identifiers in the order of the numbers at their uris, so that new ones come last."""
    rows = graph.signatures(owner_kind).select(F.col("uri").alias("owner"), "id", "scheme", "literal")
    return rows.withColumn("pos", F.row_number().over(W.partitionBy("owner").orderBy(F.regexp_extract("id", r"(\d+)$", 1).try_cast("long"), "id"))).select("owner", "pos", "scheme", "literal")


def enriched_issn(provider: L.LookupProvider, identifiers: DataFrame) -> DataFrame:
    """owner, scheme, literal: the other ISSNs of the first ISSN with an answer."""
    issns = identifiers.where(F.col("scheme") == V.ISSN)
    rows = first_answers(provider, issns.select("owner", "pos", F.col("literal").alias("key")), "crossref", "journal")
    listed = rows.select("owner", F.explode(L.crossref_issns(F.col("body"), F.col("key"))).alias("literal"))
    return filters.absent(listed.select("owner", F.lit(V.ISSN).alias("scheme"), "literal").distinct(), issns)


def enriched_doi(provider: L.LookupProvider, resources: DataFrame, identifiers: DataFrame, stop_words: list[str]) -> DataFrame:
    """owner, scheme, literal: the best match of a usable title, for resources without a DOI; authors aren't asked."""
    lacking = resources.where(usable_title(F.col("title"))).select(F.col("uri").alias("owner"), "title", F.col("pub_date").alias("year"))
    lacking = lacking.join(identifiers.where(F.col("scheme") == V.DOI).select("owner"), "owner", "left_anti")
    asked = lacking.withColumn("key", L.crossref_key(F.col("title"), stop_words))
    answers = L.lookup(provider, asked, "crossref", "works").select(F.col("owner").alias("query"), "title", "year", F.lit("").alias("given"), F.lit("").alias("family"), "body")
    return L.crossref_doi(answers).select(F.col("query").alias("owner"), F.lit(V.DOI).alias("scheme"), F.col("doi").alias("literal"))


def enriched_wikidata(provider: L.LookupProvider, identifiers: DataFrame, schemes: dict[str, str]) -> DataFrame:
    """owner, scheme, literal: the first identifier that resolves, for owners without a Wikidata identifier."""
    lacking = identifiers.join(identifiers.where(F.col("scheme") == V.WIKIDATA).select("owner"), "owner", "left_anti")
    asked = filters.supported_identifiers(lacking, schemes).select("owner", "pos", L.wikidata_key(F.col("scheme"), F.col("literal")).alias("key"))
    rows = first_answers(provider, asked, "wikidata", "item")
    return rows.select("owner", F.lit(V.WIKIDATA).alias("scheme"), L.wikidata_id(F.col("body")).alias("literal")).where("literal is not null")


def enriched_openalex(provider: L.LookupProvider, identifiers: DataFrame) -> DataFrame:
    """owner, scheme, literal: all answers of all supported identifiers, for owners without an OpenAlex identifier."""
    lacking = identifiers.join(identifiers.where(F.col("scheme") == V.OPENALEX).select("owner"), "owner", "left_anti")
    asked = filters.supported_identifiers(lacking).select("owner", F.concat_ws(":", "scheme", "literal").alias("key"))
    rows = L.lookup(provider, asked, "openalex", "works")
    return rows.select("owner", F.lit(V.OPENALEX).alias("scheme"), F.explode(L.openalex_ids(F.col("body"))).alias("literal")).distinct()


def enriched_publishers(provider: L.LookupProvider, roles: DataFrame, identifiers: DataFrame, dois: DataFrame) -> DataFrame:
    """owner (agent), scheme, literal: the member of a resource's DOI for each publisher before the first that has one.

    roles: br, ar, role_type, held_by; identifiers: of agents; dois: br, doi (the last of each).
    """
    known = identifiers.where(F.col("scheme").contains(V.CROSSREF)).select(F.col("owner").alias("held_by"), F.lit(1).alias("known")).distinct()
    publishers = roles.where((F.col("role_type") == V.PUBLISHER) & F.col("held_by").isNotNull()).join(known, "held_by", "left")
    so_far = F.max(F.coalesce("known", F.lit(0))).over(W.partitionBy("br").orderBy("ar").rowsBetween(W.unboundedPreceding, W.currentRow))
    asked = publishers.withColumn("so_far", so_far).where("so_far = 0").join(dois, "br").select(F.col("held_by").alias("owner"), F.col("doi").alias("key")).distinct()
    rows = L.lookup(provider, asked, "crossref", "member").select("owner", "key", L.crossref_member(F.col("body")).alias("literal")).where("literal is not null")
    return rows.groupBy("owner").agg(F.min_by("literal", "key").alias("literal")).select("owner", F.lit(V.CROSSREF).alias("scheme"), "literal")


def _by_resource(authors: DataFrame) -> DataFrame:
    """The authors' rows with owner, and pos, the place of the resource among those of the agent."""
    place = F.row_number().over(W.partitionBy("agent").orderBy("br"))  # the resources of one author
    return authors.dropDuplicates(["agent", "br"]).withColumns({"owner": F.col("agent"), "pos": place})


def enriched_orcid(provider: L.LookupProvider, authors: DataFrame, identifiers: DataFrame) -> DataFrame:
    """owner (agent), scheme, literal: the first hit of a search whose details match the author's names.

    authors: br, agent, given, family; identifiers: of resources (owner, pos, scheme, literal). Resources without any
    identifier aren't searched for. An author's resources are searched for in order until one has a match; every distinct
    search of a round, and its hits' details, are asked once.
    """
    of_br = identifiers.groupBy(F.col("owner").alias("br")).agg(F.array_sort(F.collect_list(F.struct("pos", "scheme", "literal"))).alias("ids"))
    asked = authors.join(of_br, "br").select("br", "agent", "given", "family", orcid_search(F.col("given"), F.col("family"), F.col("ids")).alias("key"))
    listed = F.from_json("body", "result array<struct<`orcid-identifier`:struct<path:string>>>")["result"]
    name = F.from_json("body", "name struct<`given-names`:struct<value:string>,`family-name`:struct<value:string>>")["name"]

    def search(now: DataFrame) -> DataFrame:
        hits = L.lookup(provider, now.select("key").distinct(), "orcid", "search")
        hits = staged(hits.select(F.col("key").alias("search"), F.posexplode(listed).alias("pos", "hit")).select("search", "pos", F.upper(F.col("hit.orcid-identifier.path")).alias("key")), "hits")
        details = L.lookup(provider, hits, "orcid", "details").select(F.col("search").alias("query"), "pos", F.col("key").alias("orcid"), name["given-names"]["value"].alias("given"), name["family-name"]["value"].alias("family"))
        found = L.orcid_matches(details, now.select(F.col("key").alias("query"), "agent", "given", "family").distinct())
        return now.select("owner", "pos", "agent", F.col("key").alias("query")).join(found, ["query", "agent"]).select("owner", "pos", F.col("orcid").alias("literal"))

    found = first_found(_by_resource(asked.where("key is not null")), search)
    return found.select("owner", F.lit(V.ORCID).alias("scheme"), "literal")


def enriched_viaf(provider: L.LookupProvider, authors: DataFrame) -> DataFrame:
    """owner (agent), scheme, literal: the only record for the author's name and the title of a resource.

    authors: br, agent, given, family, title; one without any name isn't asked for. Resources are asked for in order until
    one has a record.
    """
    named = authors.where("coalesce(given, '') <> '' or coalesce(family, '') <> ''")

    def search(now: DataFrame) -> DataFrame:
        asked = now.select("owner", "pos", L.viaf_key(F.col("given"), F.col("family"), F.col("title")).alias("key"))
        return L.lookup(provider, asked, "viaf", "search").select("owner", "pos", L.viaf_id(F.col("body")).alias("literal")).where("literal is not null")

    return first_found(_by_resource(named), search).select("owner", F.lit(V.VIAF).alias("scheme"), "literal")


#: Identifiers of agents by which their Wikidata items are found.
AGENT_SCHEMES = {V.ORCID: "orcid", V.VIAF: "viaf"}


class GraphEnricher:
    """Adds missing identifiers to a graph. ``enrich`` returns nothing; ``graph``, ``provenance`` and ``new_ids`` hold the result.

    provider: where lookups are answered; stop_words: left out of title searches; base: what new identifiers' uris
    begin with. With checkpoint_interval N, resources are treated in batches in the order of their uris, and the graph is
    saved before each N-th one. resume_dir: a folder in which each batch's identifiers are kept once it is done; a run that
    finds batches there takes them from there and asks for the others only.
    """

    def __init__(self, graph: Graph, storage, *, provider: L.LookupProvider, stop_words: list[str] = (), base: str = "https://w3id.org/oc/meta/id/", debug: bool = False, checkpoint_interval: int | None = None, use_wikidata: bool = True, use_viaf: bool = True, use_orcid: bool = True, resume_dir: str | None = None):
        if checkpoint_interval is not None and checkpoint_interval <= 0:
            raise ValueError("checkpoint_interval must be positive")
        self.graph, self.storage, self.provider, self.base = graph, storage, provider, base
        self.stop_words, self.debug, self.checkpoint_interval = list(stop_words), debug, checkpoint_interval
        self.use_wikidata, self.use_viaf, self.use_orcid = use_wikidata, use_viaf, use_orcid
        self.resume_dir = resume_dir
        stored = storage.counters(graph.br.sparkSession) if storage is not None else None
        self.counters, self.prefix = stored or MemoryCounters(), storage.supplier_prefix if storage is not None else ""
        self.provenance: DataFrame | None = None
        self.new_ids = 0
        self._batch: DataFrame | None = None
        self._added: list[DataFrame] = []

    def _add(self, new: DataFrame, owner_kind: str) -> None:
        numbered = numbered_identifiers(self.graph, new.withColumn("owner_kind", F.lit(owner_kind)), self.base, self.counters, self.prefix)
        if count := numbered.count():
            self.graph = with_identifiers(self.graph, numbered)
            self.new_ids += count
            self._added.append(numbered)

    def _resources(self) -> DataFrame:
        chosen = filters.enrichable(self.graph.br)
        return chosen if self._batch is None else chosen.join(self._batch, "uri", "left_semi")

    def _of_resources(self) -> DataFrame:
        chosen = self._resources().select(F.col("uri").alias("owner"))
        return staged(ordered_identifiers(self.graph, "br").join(chosen, "owner", "left_semi"), "identifiers")

    def enrich(self) -> None:
        before = self.graph
        for number, batch in enumerate(self._batches()):
            if number and self.storage is not None:
                self.storage.save_graph(self.graph)
            self._batch, self._added, start = batch, [], self.graph
            if (kept := self._kept(number)) is not None:
                self.graph = with_identifiers(self.graph, kept).staged(start)
                self.new_ids += kept.count()
                continue
            self._treat()
            self.graph = self.graph.staged(start)
            self._keep(number)
        self._batch = None
        none = before.br.select(F.col("uri").alias("from_uri"), F.col("uri").alias("to_uri")).limit(0)
        delta = staged(triple_delta(before, self.graph), "delta")
        changes = delta_changes(delta, before, self.graph, none).join(update_queries(delta), "entity", "left")
        self.provenance = staged(snapshots(changes, 1, AGENT), "provenance")
        if self.storage is not None:
            self.storage.save(self.graph, self.provenance)

    def _treat(self) -> None:
        """All lookups for the batch's resources and their authors and publishers."""
        self._add(enriched_issn(self.provider, self._of_resources()), "br")
        self._add(enriched_doi(self.provider, self._resources(), self._of_resources(), self.stop_words), "br")
        if self.use_wikidata:
            self._add(enriched_wikidata(self.provider, self._of_resources(), V.RESOURCE_SCHEMES), "br")
        self._add(enriched_openalex(self.provider, self._of_resources()), "br")
        self._enrich_authors()
        roles = contributions(self.graph).join(self._resources().select(F.col("uri").alias("br")), "br", "left_semi")
        dois = filters.classify_resource_identifiers(self._of_resources()).where("doi is not null").select(F.col("owner").alias("br"), "doi")
        self._add(enriched_publishers(self.provider, roles, ordered_identifiers(self.graph, "ra"), dois), "ra")

    def _batches(self) -> list[DataFrame | None]:
        """The uris of each batch, of which all but the first begin with an N-th resource; one of all without an interval."""
        if self.checkpoint_interval is None:
            return [None]
        spread = staged(self.graph.br.select("uri").repartitionByRange("uri").sortWithinPartitions("uri").withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "order")
        sizes = spread.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
        before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a partition
        place = spread.join(sizes.select("part", "first", before.alias("before")), "part")
        numbered = staged(place.select("uri", F.floor((F.col("before") + F.col("row") - F.col("first") + 1) / self.checkpoint_interval).alias("batch")), "batches")
        numbers = [r["batch"] for r in numbered.select("batch").distinct().orderBy("batch").collect()]  # as many as saves
        return [numbered.where(F.col("batch") == n).select("uri") for n in numbers]

    def _keep(self, number: int) -> None:
        """Write what a batch added; the table's success marker, which comes last, says that the batch is done."""
        if self.resume_dir is not None:
            spark = self.graph.br.sparkSession
            found = functools.reduce(DataFrame.unionByName, self._added) if self._added else spark.createDataFrame([], NUMBERED)
            found.write.mode("overwrite").parquet(f"{self.resume_dir}/batch-{number:09d}")

    def _kept(self, number: int) -> DataFrame | None:
        if self.resume_dir is None:
            return None
        spark = self.graph.br.sparkSession
        path = f"{self.resume_dir}/batch-{number:09d}"
        marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        done = marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
        return spark.read.schema(NUMBERED).parquet(path) if done else None

    def _authors(self, lacking: str) -> DataFrame:
        """br, agent, given, family, title of the authors without an identifier of a catalogue (orcid, viaf, wikidata)."""
        roles = contributions(self.graph).where(F.col("role_type") == V.AUTHOR).join(self._resources().select(F.col("uri").alias("br"), "title"), "br")
        held = filters.classify_agent_identifiers(ordered_identifiers(self.graph, "ra")).where(f"has_{lacking}").select(F.col("owner").alias("held_by"))
        agents = self.graph.ra.select(F.col("uri").alias("held_by"), F.col("given_name").alias("given"), F.col("family_name").alias("family"))
        return roles.join(held, "held_by", "left_anti").join(agents, "held_by").select("br", F.col("held_by").alias("agent"), "given", "family", "title")

    def _enrich_authors(self) -> None:
        if self.use_orcid:
            self._add(enriched_orcid(self.provider, self._authors("orcid"), self._of_resources()), "ra")
        if self.use_viaf:
            self._add(enriched_viaf(self.provider, self._authors("viaf")), "ra")
        if self.use_wikidata:
            authors = self._authors("wikidata").select(F.col("agent").alias("owner")).distinct()
            held = ordered_identifiers(self.graph, "ra").join(authors, "owner", "left_semi")
            self._add(enriched_wikidata(self.provider, staged(held, "held"), AGENT_SCHEMES), "ra")
