"""A Merkle manifest of a dataset, with proofs by coordinate lookups.

Every row is a leaf. The leaves of a source, in order of their ids, are the lowest level of the source's tree; runs of
``2 ** BITS`` consecutive nodes make the nodes of the level above. The trees' roots, in order of the sources, are the
leaves of one more tree, whose root stands for the dataset. A node's coordinate is its tree, level and index, and the
node tables of all levels are written.

A proof asks for the coordinates of siblings: from a node's index and its level's size follow those of its run, which
are exploded, looked up in the node table, ordered and concatenated. Leaves of one run need the same coordinates but
for their own, and so do all nodes below one node from there on, so coordinates are exploded once for a run and handed
down level by level: no coordinate is asked for by more than one run, however large a source is.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import positioned, scratch, staged

#: Runs have 2 ** BITS nodes.
BITS = 4
#: A source's rows meet the source's size by slices of 2 ** SLICE_BITS rows.
SLICE_BITS = 12
#: What a leaf says, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<top:boolean,level:int,members:array<string>>>"


def leaf_digest(**fields: Column) -> Column:
    """The digest of fields in FIELDS: each ``-`` if null, else its UTF-8 byte count, a colon and its value."""
    said = []
    for name in FIELDS:
        value = fields.get(name, F.col(name)).cast("string")
        said.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*said).cast("binary"), 256)


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case and all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _run(index: str = "idx") -> Column:
    return F.shiftright(index, BITS)


def _levels(leaves: DataFrame) -> list[DataFrame]:
    """The node tables (tree, idx, n, digest) of all levels, n being the level's size in the tree, from the lowest."""
    levels = [leaves]
    while (open_ := levels[-1].where("n > 1")).limit(1).count():
        runs = open_.groupBy("tree", _run().alias("run")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("members"))
        digest = F.sha2(F.array_join(F.transform("members", lambda m: m["digest"]), "").cast("binary"), 256)
        levels.append(staged(runs.select("tree", F.col("run").alias("idx"), (_run_count()).alias("n"), digest.alias("digest")), "nodes"))
    return levels


def _run_count() -> Column:
    return F.shiftright(F.col("n") + (1 << BITS) - 1, BITS)


def _roots(levels: list[DataFrame]) -> DataFrame:
    """tree, digest of each tree's root."""
    found = [nodes.where("n = 1").select("tree", "digest") for nodes in levels]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _siblings(nodes: DataFrame) -> DataFrame:
    """tree, run, members: the digests of each run in order, looked up by the coordinates that its first node explodes."""
    last = F.least(F.col("idx") + (1 << BITS) - 1, F.col("n") - 1)
    first = nodes.where((F.col("n") > 1) & (F.col("idx").bitwiseAND((1 << BITS) - 1) == 0))
    asked = first.select("tree", _run().alias("run"), F.explode(F.sequence("idx", last)).alias("idx"))
    found = asked.join(nodes.select("tree", "idx", "digest"), ["tree", "idx"])
    ordered = F.array_sort(F.collect_list(F.struct("idx", "digest")))
    return found.groupBy("tree", "run").agg(F.transform(ordered, lambda m: m["digest"]).alias("members"))


def _paths(levels: list[DataFrame], above: DataFrame, top: bool) -> DataFrame:
    """tree, run, path: for every run of the lowest level its own members and those of all runs on the way to the root.

    above: tree, path of what lies above each tree's root. A tree of one leaf has run 0 and the path above it.
    """
    found = None
    for level in range(len(levels) - 1, -1, -1):
        ends = levels[level].where("n = 1").select("tree", F.lit(0).cast("long").alias("run")).join(above, "tree")
        handed = ends if found is None else ends.unionByName(found)
        if level == 0:
            return staged(handed, "paths")
        own = F.array(F.struct(F.lit(top).alias("top"), F.lit(level - 1).alias("level"), F.col("members").alias("members"))).cast(PATH)
        below = _siblings(levels[level - 1])
        handed = handed.select("tree", F.col("run").alias("_above"), F.col("path").alias("_path"))
        joined = below.withColumn("_above", _run("run")).join(handed, ["tree", "_above"])
        found = staged(joined.select("tree", "run", F.concat(own, F.col("_path")).alias("path")), "paths")
    raise ValueError("a tree has at least one level")


@dataclasses.dataclass(frozen=True)
class Manifest:
    """leaves: rows' columns with tree, idx, n, leaf; nodes, top: node tables by level; subroots: tree, n_trees, subroot; root."""

    leaves: DataFrame
    nodes: list[DataFrame]
    top: list[DataFrame]
    subroots: DataFrame
    root: str | None


def build_manifest(rows: DataFrame) -> Manifest:
    """The manifest of rows with the columns doc_id, source, leaf and _tie (any order of equal rows), and others that are kept.

    Leaves of a source ascend by doc_id, null first, then by leaf; sources ascend bytewise, null first.
    """
    taken = [c for c in rows.columns if c not in ("source", "_tie")]
    placed = positioned(rows, [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("_tie")], "idx", "source")
    placed = staged(placed.drop("_tie"), "placed")
    sizes = positioned(placed.groupBy("source").agg(F.count("*").alias("n")), [F.col("source").asc_nulls_first()], "tree")
    sizes = staged(sizes.select(F.col("source").alias("_source"), "tree", "n"), "trees")
    # a source's rows are many, so they meet its size by ranges of their indexes
    sliced = sizes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n") - 1, SLICE_BITS))).alias("_slice"))
    on = F.col("source").eqNullSafe(F.col("_source")) & (F.shiftright("idx", SLICE_BITS) == F.col("_slice"))
    leaves = staged(placed.join(sliced, on).select("source", *taken, "tree", "idx", "n"), "leaves")
    nodes = _levels(leaves.select("tree", "idx", "n", F.col("leaf").alias("digest")))
    subroots = staged(_roots(nodes).withColumnRenamed("digest", "subroot"), "subroots")
    top = _levels(subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(subroots.count()).alias("n"), F.col("subroot").alias("digest")))
    found = _roots(top).first()
    return Manifest(leaves, nodes, top, subroots, found and found["digest"])


def proofs(manifest: Manifest) -> DataFrame:
    """The manifest's leaves with subroot and ``path``: for each level up to the root the members of the run on the way."""
    none = manifest.top[0].select("tree").distinct().select("tree", F.array().cast(PATH).alias("path"))
    of_top = _paths(manifest.top, none, True).select(F.col("run").alias("_run"), F.col("path").alias("path"))
    above = manifest.subroots.withColumn("_run", _run("tree")).join(of_top, "_run").select("tree", "path")
    paths = _paths(manifest.nodes, staged(above, "above"), False)
    runs = paths.join(manifest.subroots, "tree").select(F.col("tree"), F.col("run").alias("_run"), "path", "subroot")
    return manifest.leaves.withColumn("_run", _run()).join(runs, ["tree", "_run"]).drop("_run")


#: A node's place among the members of its run, in an element ``e`` of a path.
_PLACE = f"cast(shiftright(if(e.top, tree, idx), {BITS} * e.level) & {(1 << BITS) - 1} as int)"


def proof_text() -> Column:
    """All siblings of a path, level by level to the root, left to right, without the nodes on the way."""
    return F.expr(f"array_join(flatten(transform(path, e -> concat(slice(e.members, 1, {_PLACE}), slice(e.members, {_PLACE} + 2, {1 << BITS})))), '')")


def folded(leaf: str) -> Column:
    """The root that a leaf (a column's name) and the siblings of its path give."""
    joined = f"concat(array_join(slice(e.members, 1, {_PLACE}), ''), up, array_join(slice(e.members, {_PLACE} + 2, {1 << BITS}), ''))"
    return F.expr(f"aggregate(path, {leaf}, (up, e) -> sha2(cast({joined} as binary), 256))")


def verified_manifest(docs: DataFrame, folds: int = 5) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Documents whose id's crc32 is divisible by ``folds`` are tampered with, their text being lower-cased, and are folded
    from the leaf this gives with the siblings of the untouched one. Null fields are leaves' ``-``; a null id is never
    tampered with and comes first in its source, a null source first of all. Repeated rows are leaves of their own, one
    after another. Other columns are ignored; an empty table gives no rows. A text of any length is one digest.
    """
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False)) & F.col("text").isNotNull()
    rows = docs.select("doc_id", "source", leaf_digest().alias("leaf"), F.when(tampered, leaf_digest(text=lowered(F.col("text")))).alias("_tampered"), F.rand(7).alias("_tie"))
    with scratch(docs.sparkSession) as keep:
        manifest = build_manifest(staged(rows, "digests"))
        found = proofs(manifest).withColumn("_given", F.coalesce("_tampered", "leaf")).withColumn("folded_root", folded("_given"))
        root = F.lit(manifest.root).cast("string")
        out = found.select("doc_id", "leaf", "subroot", root.alias("root"), F.sha2(proof_text().cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))
        return keep(out, "manifest")


MERKLE_SQL = """
WITH RECURSIVE d AS (
  SELECT *, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') AS head,
    list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))) AS register
  FROM documents
), l AS (
  SELECT doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(register, 4294967295) % 5 = 0
      THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
  FROM d
), node(tree, level, idx, n, digest) AS (
  SELECT tree, 0, idx, n, leaf FROM l
  UNION ALL
  SELECT tree, max(level) + 1, idx // 16, (max(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM node WHERE n > 1 GROUP BY tree, idx // 16
), sub AS (SELECT tree, digest AS subroot FROM node WHERE n = 1),
top(level, idx, n, digest) AS (
  SELECT 0, tree, (SELECT count(*) FROM sub), subroot FROM sub
  UNION ALL
  SELECT max(level) + 1, idx // 16, (max(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY idx // 16
), r AS (SELECT digest AS root FROM top WHERE n = 1),
runs AS (
  SELECT tree, level, idx // 16 AS run, list(digest ORDER BY idx) AS members, false AS above FROM node WHERE n > 1 GROUP BY tree, level, idx // 16
  UNION ALL
  SELECT 0, level, idx // 16, list(digest ORDER BY idx), true FROM top WHERE n > 1 GROUP BY level, idx // 16
), fold(doc_id, tree, idx, level, above, acc, proof) AS (
  SELECT doc_id, tree, idx, 0, false, coalesce(tampered, leaf), '' FROM l
  UNION ALL
  SELECT * FROM (
    SELECT f.doc_id, f.tree, f.idx // 16, f.level + 1, f.above,
      sha256(array_to_string(list_concat(r.members[1:(f.idx % 16)], [f.acc], r.members[(f.idx % 16) + 2:]), '')),
      f.proof || array_to_string(list_concat(r.members[1:(f.idx % 16)], r.members[(f.idx % 16) + 2:]), '')
    FROM fold f JOIN runs r ON r.above = f.above AND r.tree = CASE WHEN f.above THEN 0 ELSE f.tree END AND r.level = f.level AND r.run = f.idx // 16
    UNION ALL
    SELECT f.doc_id, f.tree, f.tree, 0, true, f.acc, f.proof
    FROM fold f JOIN node t ON t.tree = f.tree AND t.level = f.level AND t.n = 1 WHERE NOT f.above
  )
)
SELECT l.doc_id, l.leaf, sub.subroot, r.root, sha256(f.proof) AS proof_sha256, f.acc AS folded_root, f.acc = r.root AS verified
FROM l JOIN sub USING (tree) CROSS JOIN r JOIN fold f ON f.doc_id = l.doc_id AND f.above AND f.level = (SELECT max(level) FROM top)
"""
