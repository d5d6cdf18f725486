"""Containers of resources: chains of part_of, their alignment, and equivalence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from citeweave.functions import vocabulary as V
from citeweave.functions.text import agent_full_name, normalized_text
from citeweave.graph import Graph
from citeweave.operators.contributors import first_publishers
from citeweave.operators.filters import specific_types
from citeweave.staging import staged

#: Starts whose chains a task puts together.
STARTS_A_TASK = 100_000


def part_of_chain(resources: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """br, ancestor, depth (1 is the container itself); an ancestor met before ends the walk, which else goes to the root.

    Jumps from every container double in each round, and walks from the starts' containers go as far again, so the rounds,
    of one written table each, grow with the logarithm of the depth and not with what contains nothing. At the end the
    starts take what their containers have reached. An ancestor counts at its least depth, and none is its own, so in a
    cycle nothing new is reached after one turn.
    """
    links = resources.where("part_of is not null and part_of <> uri").select(F.col("uri").alias("br"), F.col("part_of").alias("ancestor"), F.lit(1).alias("depth"))
    begun = staged(links if starts is None else links.join(starts.select(F.col("uri").alias("br")).distinct(), "br", "left_semi"), "begun")
    firsts = begun.select(F.col("ancestor").alias("br")).distinct()
    inner = links.join(links.select(F.col("ancestor").alias("br")).distinct(), "br", "left_semi").join(firsts.withColumn("walks", F.lit(True)), "br", "left")
    state = staged(inner.select(F.explode(F.when(F.col("walks"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("jump"), "br", "ancestor", "depth"), "chain")
    reached, before = state.where("not jump"), -1
    while before < (now := reached.count()) and state.where("jump").limit(1).count():
        before = now
        ahead = state.where("jump").select(F.col("br").alias("ancestor"), F.col("ancestor").alias("further"), F.col("depth").alias("more"))
        on = state.join(ahead, "ancestor").select("jump", "br", F.col("further").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        walks = reached.unionByName(on.where("not jump and br <> ancestor")).groupBy("br", "ancestor").agg(F.min("depth").alias("depth"))
        state = staged(on.where("jump").unionByName(walks.select(F.lit(False).alias("jump"), "*")), "chain")
        reached = state.where("not jump")
    above = firsts.select(F.col("br").alias("ancestor"), F.col("br").alias("further"), F.lit(0).alias("more"))
    above = above.unionByName(reached.select(F.col("br").alias("ancestor"), F.col("ancestor").alias("further"), F.col("depth").alias("more")))
    met = begun.join(above, "ancestor").select("br", F.col("further").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
    parts = max(resources.sparkSession.sparkContext.defaultParallelism, begun.count() // STARTS_A_TASK + 1)
    return met.where("br <> ancestor").repartition(parts, "br").groupBy("br", "ancestor").agg(F.min("depth").alias("depth"))


def container_equivalence(first: dict[str, Column], second: dict[str, Column]) -> Column:
    """Identifiers decide if both have them, else numbers, else normalised titles; with none in common they differ."""
    both = lambda name: first[name].isNotNull() & second[name].isNotNull()
    return (
        F.when((F.size(first["sigs"]) > 0) & (F.size(second["sigs"]) > 0), F.arrays_overlap(first["sigs"], second["sigs"]))
        .when(both("number"), first["number"] == second["number"])
        .when(both("title"), normalized_text(first["title"]) == normalized_text(second["title"]))
        .otherwise(F.lit(False))
    )


def container_pairs(resources: DataFrame, signatures: DataFrame, pairs: DataFrame, expression: str = V.EXPRESSION) -> DataFrame:
    """first_br, second_br, first, second, level (depth in the first chain), equivalent, merges.

    pairs: first_br, second_br. Each container of the first chain meets the nearest container of the second chain that
    has its first matching specific type. Levels that are the same resource, or meet none, are skipped; from the root
    down, one that isn't equivalent stops all below it from merging.
    """
    ends = pairs.select(F.col("first_br").alias("uri")).unionByName(pairs.select(F.col("second_br").alias("uri")))
    chain = staged(part_of_chain(resources, ends), "chains")
    resources = staged(resources.join(chain.select(F.col("ancestor").alias("uri")).distinct(), "uri", "left_semi"), "containers")
    typed = resources.select(F.col("uri").alias("ancestor"), F.posexplode(specific_types(F.col("types"), expression)).alias("type_pos", "type"))
    left = chain.join(typed, "ancestor").select(F.col("br").alias("first_br"), F.col("ancestor").alias("first"), F.col("depth").alias("level"), "type_pos", "type")
    right = chain.join(typed, "ancestor").groupBy(F.col("br").alias("second_br"), "type").agg(F.min_by("ancestor", F.struct("depth", "type_pos")).alias("second"))
    met = pairs.join(left, "first_br").join(right, ["second_br", "type"])
    met = met.groupBy("first_br", "second_br", "first", "level").agg(F.min_by("second", "type_pos").alias("second")).where("first <> second")
    sigs = signatures.groupBy("uri").agg(F.collect_set(F.struct("scheme", "literal")).alias("sigs"))
    facts = resources.join(sigs, "uri", "left").select("uri", "number", "title", F.coalesce("sigs", F.array().cast("array<struct<scheme:string,literal:string>>")).alias("sigs"))
    side = lambda name: facts.select(F.col("uri").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("number", "title", "sigs")])
    of = lambda name: {c: F.col(f"{name}_{c}") for c in ("number", "title", "sigs")}
    judged = met.join(side("first"), "first").join(side("second"), "second").withColumn("equivalent", container_equivalence(of("first"), of("second")))
    from_root = W.partitionBy("first_br", "second_br").orderBy(F.col("level").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return judged.select("first_br", "second_br", "first", "second", "level", "equivalent", F.min("equivalent").over(from_root).alias("merges"))


def publisher_equivalence(first: dict[str, Column], second: dict[str, Column]) -> Column:
    """The same agent, else overlapping identifiers if both have them, else equal full names; a missing agent is unequal."""
    return F.coalesce(
        F.when(first["agent"].isNull() | second["agent"].isNull(), F.lit(False))
        .when(first["agent"] == second["agent"], F.lit(True))
        .when((F.size(first["sigs"]) > 0) & (F.size(second["sigs"]) > 0), F.arrays_overlap(first["sigs"], second["sigs"]))
        .otherwise(first["full_name"] == second["full_name"]),
        F.lit(False),
    )


def publisher_pairs(graph: Graph, pairs: DataFrame) -> DataFrame:
    """first_br, second_br, first, second (publisher roles), equivalent, of the pairs whose publishers are two roles."""
    sigs = graph.signatures("ra").groupBy("uri").agg(F.collect_set(F.struct("scheme", "literal")).alias("sigs"))
    named = graph.ra.select("uri", agent_full_name(F.col("name"), F.col("given_name"), F.col("family_name")).alias("full_name"))
    facts = first_publishers(graph).join(named.join(sigs, "uri", "full"), F.col("agent") == F.col("uri"), "left")
    facts = facts.select("br", "publisher", "agent", "full_name", F.coalesce("sigs", F.array().cast("array<struct<scheme:string,literal:string>>")).alias("sigs"))
    side = lambda name: facts.select(F.col("br").alias(f"{name}_br"), F.col("publisher").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("agent", "full_name", "sigs")])
    of = lambda name: {c: F.col(f"{name}_{c}") for c in ("agent", "full_name", "sigs")}
    met = pairs.join(side("first"), "first_br").join(side("second"), "second_br").where("first <> second")
    return met.select("first_br", "second_br", "first", "second", publisher_equivalence(of("first"), of("second")).alias("equivalent"))


def container_members(resources: DataFrame) -> DataFrame:
    """uri of everything that contains something."""
    return resources.where("part_of is not null").select(F.col("part_of").alias("uri")).distinct()
