"""Snapshots of what a step created, changed, merged or deleted."""

from __future__ import annotations

import dataclasses
import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from citeweave.functions import vocabulary as V
from citeweave.graph import KINDS, SCHEMAS, Graph
from citeweave.sources.ntriples import line_column, row_triples

TRIPLE = ("s", "p", "o", "o_kind", "o_datatype", "o_lang")


def entity_states(graph: Graph) -> DataFrame:
    """uri and a digest of everything the graph says of an entity."""
    parts = [getattr(graph, k).select("uri", F.to_json(F.struct(*[c for c in getattr(graph, k).columns if c != "uri"])).alias("fact")) for k in KINDS]
    parts.append(graph.br_ar.select(F.col("br").alias("uri"), F.concat(F.lit("ar "), "ar").alias("fact")))
    parts.append(graph.ent_id.select(F.col("owner").alias("uri"), F.concat(F.lit("id "), "id").alias("fact")))
    parts.append(graph.triples.select(F.col("s").alias("uri"), F.to_json(F.struct("p", "o", "o_kind")).alias("fact")))
    facts = parts[0]
    for more in parts[1:]:
        facts = facts.unionByName(more)
    hashed = F.xxhash64("fact").cast("decimal(38,0)")
    return facts.groupBy("uri").agg(F.sum(hashed).alias("digest"), F.count("*").alias("n_facts"))


def snapshots(changes: DataFrame, number: int, agent: str) -> DataFrame:
    """Changes with the number of the step that made them, who is responsible, and when."""
    return changes.withColumns({"number": F.lit(number), "agent": F.lit(agent), "time": F.current_timestamp()})


def provenance_diff(before: DataFrame, after: DataFrame, redirects: DataFrame) -> DataFrame:
    """entity, kind (creation, modification, merge, deletion), derived_from, absorbed_by.

    before and after: uri and any state columns; a merge is derived from the survivor and all it absorbed, and a
    merged entity's deletion names the survivor.
    """
    state = lambda df, name: df.select("uri", F.struct(*[c for c in df.columns if c != "uri"]).alias(name))
    both = state(before, "old").join(state(after, "new"), "uri", "full_outer")
    absorbed = redirects.groupBy(F.col("to_uri").alias("uri")).agg(F.array_sort(F.collect_set("from_uri")).alias("absorbed"))
    gone = redirects.select(F.col("from_uri").alias("uri"), F.col("to_uri").alias("absorbed_by"))
    kind = (
        F.when(F.col("old").isNull(), "creation")
        .when(F.col("new").isNull(), "deletion")
        .when(F.col("absorbed").isNotNull(), "merge")
        .when(~F.col("old").eqNullSafe(F.col("new")), "modification")
    )
    # hinted, as all sides are dealt by uri anyway: by the size of the files, millions of rows would pass through the driver
    rows = both.join(absorbed.hint("merge"), "uri", "left").join(gone.hint("merge"), "uri", "left").withColumn("kind", kind).where("kind is not null")
    sources = F.when(F.col("kind") == "creation", F.array().cast("array<string>")).otherwise(F.concat(F.array("uri"), F.coalesce("absorbed", F.array().cast("array<string>"))))
    return rows.select(F.col("uri").alias("entity"), "kind", sources.alias("derived_from"), F.when(F.col("kind") == "deletion", F.col("absorbed_by")).alias("absorbed_by"))


def triple_delta(old: Graph, new: Graph) -> DataFrame:
    """s, p, o, o_kind, o_datatype, o_lang, n: how many more of a triple the new graph has than the old one, or fewer.

    Tables are compared as bags of rows, with partial sums before the shuffle, and only those that aren't the same table
    in both graphs are read; of the rows that differ the triples are compared.
    """
    parts = []
    for name in (f.name for f in dataclasses.fields(Graph)):
        before, after = getattr(old, name), getattr(new, name)
        if before is not after:
            columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
            sides = before.select(*columns, F.lit(-1).alias("n")).unionByName(after.select(*columns, F.lit(1).alias("n")))
            parts.append(row_triples(name, sides.groupBy(*columns).agg(F.sum("n").alias("n")).where("n <> 0"), ("n",)))
    if not parts:
        return old.triples.select(*TRIPLE, F.lit(0).cast("long").alias("n")).limit(0)
    both = functools.reduce(DataFrame.unionByName, parts)
    return both.groupBy(*TRIPLE).agg(F.sum("n").alias("n")).where("n <> 0")


def replayed(triples: DataFrame, delta: DataFrame) -> DataFrame:
    """The triples after a delta: what it takes away is taken away, what it adds is added."""
    counted = triples.groupBy(*TRIPLE).agg(F.count("*").alias("n")).unionByName(delta.select(*TRIPLE, "n"))
    left = counted.groupBy(*TRIPLE).agg(F.sum("n").alias("n")).where("n > 0")
    return left.select(*TRIPLE, F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("_time")).select(*TRIPLE)


def delta_changes(delta: DataFrame, old: Graph, new: Graph, merges: DataFrame) -> DataFrame:
    """entity, kind (creation, modification, merge, deletion), derived_from, absorbed_by, of what a delta or a merge touches.

    merges: from_uri, to_uri of entities that absorbed others and where these ended.
    """
    touched = delta.select(F.col("s").alias("uri")).unionByName(merges.select(F.col("from_uri").alias("uri"))).unionByName(merges.select(F.col("to_uri").alias("uri"))).distinct()

    def held(graph: Graph) -> DataFrame:
        subjects = graph.entities().select("uri").unionByName(graph.triples.select(F.col("s").alias("uri")))
        return subjects.join(touched, "uri", "left_semi").distinct()

    sides = held(old).select("uri", F.lit(1).alias("was"), F.lit(0).alias("is")).unionByName(held(new).select("uri", F.lit(0).alias("was"), F.lit(1).alias("is")))
    sides = sides.groupBy("uri").agg(F.max("was").alias("was"), F.max("is").alias("is"))
    absorbed = merges.groupBy(F.col("to_uri").alias("uri")).agg(F.array_sort(F.collect_set("from_uri")).alias("absorbed"))
    gone = merges.select(F.col("from_uri").alias("uri"), F.col("to_uri").alias("absorbed_by")).distinct()
    kind = F.when(F.col("was") == 0, "creation").when(F.col("is") == 0, "deletion").when(F.col("absorbed").isNotNull(), "merge").otherwise("modification")
    none = F.array().cast("array<string>")
    rows = sides.join(absorbed, "uri", "left").join(gone, "uri", "left").withColumn("kind", kind)
    sources = F.when(F.col("kind") == "creation", none).otherwise(F.concat(F.array("uri"), F.coalesce("absorbed", none)))
    return rows.select(F.col("uri").alias("entity"), "kind", sources.alias("derived_from"), F.when(F.col("kind") == "deletion", F.col("absorbed_by")).alias("absorbed_by"))


def update_queries(delta: DataFrame) -> DataFrame:
    """entity, update: the SPARQL update of each entity's part of a delta."""
    lines = lambda sign: F.array_join(F.array_sort(F.collect_list(F.when(sign, line_column()))), " ")
    held = delta.groupBy(F.col("s").alias("entity")).agg(lines(F.col("n") < 0).alias("gone"), lines(F.col("n") > 0).alias("come"))
    part = lambda word, column: F.when(F.col(column) != "", F.concat(F.lit(f"{word} DATA {{ "), column, F.lit(" }")))
    return held.select("entity", F.concat_ws("; ", part("DELETE", "gone"), part("INSERT", "come")).alias("update"))


def snapshot_uri(entity: Column, number: Column) -> Column:
    return F.concat(entity, F.lit("/prov/se/"), number.cast("string"))


def chained(changes: DataFrame, last: DataFrame) -> DataFrame:
    """The changes as numbered snapshots, each entity's following its last one.

    changes: entity, kind, derived_from, number of the step, agent, time, update; last: entity, last (the number of its
    last snapshot). A snapshot ends when the next one begins, that of a deletion at once; it derives from the entity's
    snapshot before it and, for a merge, from those that the absorbed entities had. Returns entity, seq, kind, description,
    sources (snapshots), agent, generated, invalidated, update.
    """
    own = W.partitionBy("entity").orderBy("number")  # the steps of one entity
    rows = changes.join(last, "entity", "left").withColumn("seq", F.coalesce("last", F.lit(0)) + F.row_number().over(own)).withColumn("_next", F.lead("time").over(own))
    others = rows.select("entity", "number", F.explode(F.array_except("derived_from", F.array("entity"))).alias("other"))
    before = rows.where("kind = 'deletion' and seq > 1").select(F.col("entity").alias("other"), "number", snapshot_uri(F.col("entity"), F.col("seq") - 1).alias("source"))
    absorbed = others.join(before, ["other", "number"], "left").groupBy("entity", "number").agg(F.array_sort(F.collect_list("source")).alias("absorbed"), F.array_sort(F.collect_list("other")).alias("others"))
    rows = rows.join(absorbed, ["entity", "number"], "left")
    mine = F.when(F.col("seq") > 1, F.array(snapshot_uri(F.col("entity"), F.col("seq") - 1))).otherwise(F.array().cast("array<string>"))
    done = F.when(F.col("kind") == "creation", "created").when(F.col("kind") == "deletion", "deleted").when(F.col("kind") == "modification", "modified")
    merged = F.concat(F.lit("merged with '"), F.array_join("others", "', '"), F.lit("'"))
    description = F.concat(F.lit("The entity '"), "entity", F.lit("' has been "), F.coalesce(done, merged), F.lit("."))
    ended = F.coalesce(F.when(F.col("kind") == "deletion", F.col("time")), F.col("_next"))
    sources = F.concat(mine, F.coalesce("absorbed", F.array().cast("array<string>")))
    return rows.select("entity", "seq", "kind", description.alias("description"), sources.alias("sources"), "agent", F.col("time").alias("generated"), ended.alias("invalidated"), "update")


def moment(time: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def snapshot_quads(snapshots: DataFrame, labels: bool = True) -> DataFrame:
    """g, s, p, o, o_kind, o_datatype, o_lang of chained snapshots, each entity's in a graph of its own."""
    text = "http://www.w3.org/2001/XMLSchema#string"
    fact = lambda p, o, kind, datatype=None: F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("o_datatype"))
    one = [
        fact(V.RDF_TYPE, F.lit(V.SNAPSHOT), "uri"), fact(V.SNAPSHOT_OF, F.col("entity"), "uri"), fact(V.BEGAN, moment(F.col("generated")), "literal", V.DATE_TIME),
        fact(V.ENDED, moment(F.col("invalidated")), "literal", V.DATE_TIME), fact(V.DONE_BY, F.col("agent"), "uri"), fact(V.DESCRIPTION, F.col("description"), "literal", text),
        fact(V.UPDATE, F.nullif("update", F.lit("")), "literal", text),
    ]
    if labels:
        one.append(fact(V.LABEL, F.concat(F.lit("snapshot "), F.col("seq").cast("string"), F.lit(" of "), "entity"), "literal", text))
    sources = F.transform("sources", lambda u: F.struct(F.lit(V.DERIVED_FROM).alias("p"), u.alias("o"), F.lit("uri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype")))
    facts = F.explode(F.concat(F.array(*one), sources)).alias("f")
    rows = snapshots.select(F.concat("entity", F.lit("/prov/")).alias("g"), snapshot_uri(F.col("entity"), F.col("seq")).alias("s"), facts)
    return rows.select("g", "s", "f.*", F.lit(None).cast("string").alias("o_lang")).where("o is not null")


def continued(stored: DataFrame, changes: DataFrame, labels: bool = True) -> DataFrame:
    """Stored snapshots' quads with those of further changes: the last snapshot of a changed entity ends, new ones follow."""
    mine = stored.where((F.col("p") == V.SNAPSHOT_OF)).select(F.col("o").alias("entity"), "s", F.regexp_extract("s", r"(\d+)$", 1).cast("long").alias("n"))
    last = mine.groupBy("entity").agg(F.max("n").alias("last"))
    begun = changes.groupBy("entity").agg(F.min("time").alias("time"))
    over = stored.where(F.col("p") == V.ENDED).select("s")
    closing = last.join(begun, "entity").select(F.concat("entity", F.lit("/prov/")).alias("g"), snapshot_uri(F.col("entity"), F.col("last")).alias("s"), moment(F.col("time")).alias("o")).join(over, "s", "left_anti")
    none = F.lit(None).cast("string")
    closed = closing.select("g", "s", F.lit(V.ENDED).alias("p"), "o", F.lit("literal").alias("o_kind"), F.lit(V.DATE_TIME).alias("o_datatype"), none.alias("o_lang"))
    return stored.unionByName(closed).unionByName(snapshot_quads(chained(changes, last), labels))
