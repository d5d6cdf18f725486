"""Exact deduplication by deterministic block naming, in DataFrame operations only.

Every normalised text is cut into fixed-size blocks of bytes. Distinct blocks are sorted and numbered,
so equal blocks, and only those, share an integer name. Adjacent names are then paired and the
distinct pairs are sorted and numbered in turn, until each document has one name. Two documents are
equal exactly when they end on the same level with the same name: names stand for content, not for
hash values, so there are no collisions.

The block bytes cross the network once, to be named. Occurrences refer to a block by a 128-bit
fingerprint; names whose fingerprint is shared by different blocks are joined by content instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from citeweave.llm.common import drop_staged, staged

WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
BLOCK_BYTES = 4096


def without_white(text: Column) -> Column:
    """The text, null as empty, after deleting every character of [\\x20\\x09-\\x0D]."""
    out = F.coalesce(text, F.lit(""))
    for white in WHITE:
        out = F.replace(out, F.lit(white), F.lit(""))
    return out


def fingerprint(data: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes."""
    return F.xxhash64(data), F.xxhash64(F.lit(7), data)


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, marks: Callable) -> DataFrame:
    """One row per block: the row's key, its attributes on block 0, and the block's bytes and fingerprint."""
    norm = without_white(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_cp"), norm.cast("binary").alias("bytes"))
    t1, t2 = fingerprint(F.col("bytes"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / F.lit(block_bytes))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes)))
    out = rows.select("doc_id", "n_cp", t1.alias("t1"), t2.alias("t2"), F.sha2("bytes", 256).alias("text_sha256"), n.alias("n_blocks"), F.posexplode(cut).alias("pos", "block"))
    h1, h2 = marks(F.col("block"))
    return out.withColumns({"h1": h1, "h2": h2})


def document_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, marks: Callable = fingerprint) -> DataFrame:
    """One row per input row: doc_id, n_cp, text_sha256, level, name; (level, name) is the text's identity."""
    blocks = _blocks(docs, id_col, text_col, block_bytes, marks)
    key = ["doc_id", "n_cp", "t1", "t2"]
    # repeated rows (same id, same text) are one row with a count until the end
    occurrences = staged(
        blocks.groupBy(*key, "pos", "h1", "h2").agg(F.max("n_blocks").alias("n_blocks"), F.max("text_sha256").alias("text_sha256"), F.count("*").alias("copies")),
        "occurrences",
    )
    named = blocks.select("block").distinct().sortWithinPartitions("block").withColumn("name", F.monotonically_increasing_id())
    h1, h2 = marks(F.col("block"))
    per_mark = W.partitionBy("h1", "h2")
    names = staged(named.select(h1.alias("h1"), h2.alias("h2"), "name", "block").withColumn("shared", F.count("*").over(per_mark) > 1).withColumn("block", F.when(F.col("shared"), F.col("block"))), "names")
    clear = names.where("not shared").select("h1", "h2", "name")
    current = occurrences.join(clear, ["h1", "h2"])
    if names.where("shared").limit(1).count():
        unclear = names.where("shared").select("block", "name")
        by_content = blocks.select(*key, "pos", "block").distinct().join(unclear, "block").drop("block")
        by_content = by_content.select(F.col("doc_id").alias("_id"), *[c for c in by_content.columns if c != "doc_id"])
        # a null id is an id of its own
        met = occurrences.join(by_content, [*key[1:], "pos"]).where(F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")
        current = current.unionByName(met)
    current = staged(current.select(*key, "pos", "n_blocks", "text_sha256", "copies", "name"), "level")
    finished, level = [], 0
    while True:
        finished.append(current.where("n_blocks = 1").select(*key, "text_sha256", "copies", F.lit(level).alias("level"), "name"))
        if not current.where("n_blocks > 1").limit(1).count():
            break
        left, right = F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))), F.max(F.when(F.col("pos") % 2 == 1, F.col("name")))
        pairs = (
            current.where("n_blocks > 1")
            .groupBy(*key, (F.col("pos") / 2).cast("int").alias("half"))
            .agg(left.alias("left"), F.coalesce(right, F.lit(-1)).alias("right"), F.max("n_blocks").alias("n_blocks"), F.max("text_sha256").alias("text_sha256"), F.max("copies").alias("copies"))
        )
        pairs = staged(pairs.select(*key, F.col("half").alias("pos"), F.ceil(F.col("n_blocks") / 2).cast("int").alias("n_blocks"), "text_sha256", "copies", "left", "right"), "pairs")
        names = staged(pairs.select("left", "right").distinct().sortWithinPartitions("left", "right").withColumn("name", F.monotonically_increasing_id()), "names")
        current = staged(pairs.join(names, ["left", "right"]).drop("left", "right"), "level")
        drop_staged(pairs)
        drop_staged(names)
        level += 1
    rows = finished[0]
    for more in finished[1:]:
        rows = rows.unionByName(more)
    return rows.select("doc_id", "n_cp", "text_sha256", "level", "name", "copies")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, marks: Callable = fingerprint) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and empty texts form one group. Of equal texts the row with the most code
    points, then the smallest id, stays; of rows repeated with the same id and text one stays. A null id sorts
    after all others, and rows without an id are rows of their own, also where fingerprints collide. A very long text is
    many blocks, named level by level. Other columns of ``docs`` are ignored, whatever their names. An empty table gives
    an empty result.
    """
    rows = staged(document_names(docs, id_col, text_col, block_bytes, marks), "identities")
    best = F.min(F.struct((-F.col("n_cp")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id")))
    groups = staged(rows.groupBy("level", "name").agg(best.alias("best"), F.sum("copies").alias("group_size")), "groups")
    joined = rows.join(groups, ["level", "name"])
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("n_cp") == -F.col("best.less"))
    return joined.withColumn("copy", copy).select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("group_size"), (kept & (F.col("copy") == 1)).alias("kept"), "text_sha256")


EXACT_DEDUP_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents
), g AS (
  SELECT doc_id, t, count(*) OVER (PARTITION BY t) AS group_size,
         first_value(doc_id) OVER (PARTITION BY t ORDER BY cp DESC, doc_id) AS keep_id
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
