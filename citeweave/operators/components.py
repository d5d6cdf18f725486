"""Connected components of a graph given by its edges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.staging import drop_staged, staged

#: Nodes whose edges a task contracts at a time.
NODES_AT_ONCE = 250_000
#: So many contracted edges at most are finished by one task, within NODES_AT_ONCE; more go through rounds.
EDGES_OF_ONE_TASK = 1 << 15


def _contracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's edges as stars around the smallest nodes, some hundred thousand nodes at a time."""
    up: dict = {}

    def find(node):
        while (above := up.setdefault(node, node)) != node:
            up[node] = up[above]
            node = up[node]
        return node

    def stars() -> pd.DataFrame:
        linked = [(find(node), node) for node in list(up)]
        return pd.DataFrame([(a, b) for a, b in linked if a != b], columns=["a", "b"])

    for frame in frames:
        for first in range(0, len(frame), NODES_AT_ONCE):
            part = frame.iloc[first : first + NODES_AT_ONCE]
            for a, b in zip(part["a"].tolist(), part["b"].tolist(), strict=True):
                if (a := find(a)) != (b := find(b)):
                    up[max(a, b)] = min(a, b)
            if len(up) > NODES_AT_ONCE:
                yield stars()
                up.clear()
    if up:
        yield stars()


def _staged_edges(edges: DataFrame) -> tuple[DataFrame, bool]:
    """The edges contracted where they lie, and whether one task has contracted what that left, so that all are stars."""
    stars = staged(edges.where("a <> b").mapInPandas(_contracted, edges.schema), "edges")
    if stars.count() > EDGES_OF_ONE_TASK:
        return stars, False
    whole = staged(stars.coalesce(1).mapInPandas(_contracted, edges.schema), "edges")
    drop_staged(stars)
    return whole.coalesce(1), True


def _between_stars(edges: DataFrame) -> DataFrame:
    """node of every greater node that has several smaller neighbours, or is a smaller one itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("greater")).unionByName(edges.select(F.col("b").alias("node"), F.lit(1).alias("greater")))
    roles = ends.groupBy("node").agg(F.sum("greater").alias("times"), F.min("greater").alias("least"))
    return roles.where("times > 1 or (times = 1 and least = 0)").select("node")


def _all_stars(edges: DataFrame) -> bool:
    """Whether every greater node has one smaller neighbour, which is no greater node itself."""
    return not _between_stars(edges).limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``edges`` (a, b); self edges are ignored.

    Each partition's edges are contracted to stars; a task of bounded size finishes what is left if that is little, as
    rounds over a few edges cost more in tasks than in work. Else rounds of large-star and small-star steps link each
    node's neighbours to the smallest of them, so the graph shrinks to stars in a number of rounds that grows with the
    logarithm of the longest path. There a node of any degree is only ever aggregated by its minimum, never collected.
    """
    current, whole = _staged_edges(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    while not whole and not _all_stars(current):
        # large star: every neighbour above a node is linked to the node's smallest neighbour or itself
        out = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = staged(out.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")), "low")
        large = staged(out.join(low, "a").where("b > a").select(F.col("low").alias("a"), "b").where("a <> b").distinct(), "large")
        # small star: every node's smaller neighbours, and itself, are linked to the smallest of them
        least = staged(large.groupBy("b").agg(F.min("a").alias("low")), "least")
        joined = large.join(least, "b")
        new, whole = _staged_edges(joined.select(F.col("low").alias("a"), "b").unionByName(joined.select(F.col("low").alias("a"), F.col("a").alias("b"))))
        drop_staged(current, low, large, least)
        current = new
    return _members(current)


def _members(stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return stars.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)


def near_components(edges: DataFrame) -> DataFrame:
    """The same as components(), for edges that mostly join nodes near each other in order, such as uris numbered in turn.

    Edges are contracted in the order of their nodes, so that most components are whole stars at once. Only those that
    aren't go through the rounds; where no nodes are near, those are all components that one contraction leaves open.
    """
    edges = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b"), "edges")  # a sort reads them twice
    stars = staged(edges.orderBy("a", "b").mapInPandas(_contracted, edges.schema), "stars")
    between = staged(_between_stars(stars), "between")
    if not between.limit(1).count():
        return _members(stars)
    # a star is whole if none of its nodes has other edges; what is left of its component lies in open stars as well
    met = stars.join(between.withColumnRenamed("node", "b"), "b", "left_semi").select("a")
    open_ = staged(met.unionByName(between.select(F.col("node").alias("a"))).distinct(), "open")
    return _members(stars.join(open_, "a", "left_anti")).unionByName(components(stars.join(open_, "a", "left_semi").select("a", "b")))
