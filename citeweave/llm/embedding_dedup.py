"""Near-duplicate embeddings by a pivot-permutation index.

Equal vectors are one class, told by 128 bits of hashes, and a class is indexed and compared once. It is described by its
nearest pivots in order. An inverted list holds the classes that have its pivot among their first; two classes are
candidates when they share enough pivots, in the list of the first pivot they share, and the exact cosine in double
precision decides. Only counts, weighted by the sizes of classes, and one link per class to the smallest of its group
leave the list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from citeweave.llm.common import drop_staged, staged
from citeweave.operators.components import components

COSINE = 0.95
#: Pivots: nearest ones kept, least shared by candidates, and how many there are: PIVOTS_PER_ROOT times the root of
#: the number of vectors, MOST_PIVOTS and PIVOT_BYTES in single precision at most. They are the sample on which the index
#: is fitted; every vector is indexed.
NEAREST, LEAST_SHARED, PIVOTS_PER_ROOT, LEAST_PIVOTS, MOST_PIVOTS, PIVOT_BYTES = 6, 2, 4, 32, 65_536, 32 << 20
#: Pivots this close to an earlier one are left out, so that groups of copies don't take most of them.
APART = 0.7
#: Vectors of a list that one task compares with as many others.
BLOCK = 2048
ROWS_AT_ONCE = 4096


def _unit(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows have one; the rest are zero."""
    size = max((len(r) for r in rows if r is not None), default=0)
    out = np.zeros((len(rows), size))
    for at, row in enumerate(rows):
        if row is not None and len(row) and all(v is not None for v in row):
            out[at, : len(row)] = row
    with np.errstate(all="ignore"):
        peak = np.abs(out).max(1, initial=0)
        good = np.isfinite(out).all(1) & (peak > 0)
        out[~good] = 0
        out[good] /= peak[good, None]
        out[good] /= np.linalg.norm(out[good], axis=1)[:, None]
    return out, good


def choose_pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """At most n unit vectors apart from each other, from the vectors with the smallest id hashes."""
    sample = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * n).select("embedding").toPandas()["embedding"]
    rows, good = _unit(list(sample))
    rows = rows[good]
    chosen = np.zeros((0, rows.shape[1]))
    for first in range(0, len(rows), 512):
        part = rows[first : first + 512]
        free = (part @ chosen.T < APART).all(1) if len(chosen) else np.ones(len(part), bool)
        near = np.tril(part @ part.T >= APART, -1)
        for at in np.flatnonzero(free):
            free[at] = not near[at, free].any() if near[at].any() else True
        chosen = np.concatenate([chosen, part[free]])
    return chosen[:n]


def _described(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, size, pivots (nearest first), embedding of the classes of vectors that can link."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots.astype(np.float32))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for frame in frames:
            for first in range(0, len(frame), ROWS_AT_ONCE):
                part = frame.iloc[first : first + ROWS_AT_ONCE]
                unit, good = _unit(list(part["embedding"]))
                width = max(unit.shape[1], table.shape[1])
                unit = np.pad(unit, ((0, 0), (0, width - unit.shape[1])))
                cosine = unit.astype(np.float32) @ np.pad(table, ((0, 0), (0, width - table.shape[1]))).T
                k = min(NEAREST, len(table))
                near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
                near = np.take_along_axis(near, np.argsort(-np.take_along_axis(cosine, near, 1), axis=1, kind="stable"), 1)
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy()[good], "size": part["size"].to_numpy()[good], "pivots": list(near[good].astype(np.int32)), "embedding": list(unit[good])})

    return vectors.mapInPandas(run, "vec_id long, size long, pivots array<int>, embedding array<double>")


def _shared(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many pivots each row of ``a`` shares with each of ``b``."""
    out = np.zeros((len(a), len(b)), np.int8)
    for p in near[a].T:
        for q in near[b].T:
            out += p[:, None] == q[None, :]
    return out


def _compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Counts and links of one list's pair of blocks: vec_id, linked, low (the smallest id of its group here)."""
    pivot, one, other = key[0], key[1], key[2]
    frame = frame.sort_values("vec_id", kind="stable")
    ids, block, size = frame["vec_id"].to_numpy(), frame["block"].to_numpy(), frame["size"].to_numpy()
    x, near = np.array(frame["embedding"].tolist()), np.array(frame["pivots"].tolist())
    a, b = np.flatnonzero(block == one), np.flatnonzero(block == other)
    counts, low = np.zeros(len(ids), np.int64), np.arange(len(ids))
    if not len(a) or not len(b):
        return pd.DataFrame({"vec_id": ids[:0], "linked": counts[:0], "low": ids[:0]})
    rows, columns = [], []
    for first in range(0, len(a), 256):
        part = a[first : first + 256]
        enough = _shared(near, part, b) >= min(LEAST_SHARED, near.shape[1])
        if one == other:
            enough &= part[:, None] < b[None, :]
        i, j = np.nonzero(enough)
        i, j = part[i], b[j]
        for at in range(0, len(i), 1 << 16):
            p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            same = (near[p][:, :, None] == near[q][:, None, :]).any(2)
            own = np.where(same, near[p], np.iinfo(np.int32).max).min(1) == pivot
            p, q = p[own], q[own]
            close = np.einsum("ij,ij->i", x[p], x[q]) >= COSINE
            p, q = p[close], q[close]
            np.add.at(counts, p, size[q])
            np.add.at(counts, q, size[p])
            rows.append(p)
            columns.append(q)
    _spread(low, rows, columns)
    hit = counts > 0
    return pd.DataFrame({"vec_id": ids[hit], "linked": counts[hit], "low": ids[low[hit]]})


def _spread(low: np.ndarray, rows: list[np.ndarray], columns: list[np.ndarray]) -> None:
    """Lower every entry to the smallest index that the pairs connect it with."""
    if not rows:
        return
    i, j = np.concatenate(rows), np.concatenate(columns)
    while True:
        before = low.copy()
        least = np.minimum(low[i], low[j])
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low[:] = low[low]
        if (low == before).all():
            return


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing. A shorter vector is
    compared as if filled up with zeros. Rows repeated with one id are one vector (the first of its values in order)
    and give a row each; rows without an id link with nothing, have no component and stay. Other columns are ignored; an
    empty table gives no rows. Pairs whose vectors share too few pivots are missed; the tests measure recall.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    single = rows.where("vec_id is not null and embedding is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    single = staged(single.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(7), "embedding")}), "single")
    classes = staged(single.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("size"), F.min("embedding").alias("embedding")), "classes")
    n, width = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    pivots = choose_pivots(classes, int(min(MOST_PIVOTS, PIVOT_BYTES // (4 * max(width or 1, 1)), max(LEAST_PIVOTS, PIVOTS_PER_ROOT * n**0.5))))
    if not len(pivots):
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if len(pivots) <= NEAREST:
        pivots = pivots[:1]  # every vector would be in all lists: one holds each pair once, in blocks
    described = staged(_described(classes.select("vec_id", "size", "embedding"), pivots), "described")
    posted = described.select("vec_id", "size", "pivots", "embedding", F.explode("pivots").alias("pivot"))
    sizes = described.select(F.explode("pivots").alias("pivot")).groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 0")
    posted = posted.join(staged(sizes, "sizes"), "pivot").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    # a list is compared by pairs of blocks, so a long one is shared among many tasks
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = posted.withColumn("partner", partner).select("pivot", F.least("block", "partner").alias("one"), F.greatest("block", "partner").alias("other"), "block", "vec_id", "size", "pivots", "embedding")
    kinds = StructType([StructField("vec_id", LongType()), StructField("linked", LongType()), StructField("low", LongType())])
    found = staged(pairs.groupBy("pivot", "one", "other").applyInPandas(_compare, kinds), "found")
    counts = found.groupBy("vec_id").agg(F.sum("linked").alias("linked"))
    groups = components(found.select(F.col("low").alias("a"), F.col("vec_id").alias("b")))
    # a class counts its own other vectors, if it can link at all, and what it is linked with
    of_class = described.select("vec_id", "size").join(counts, "vec_id", "left").join(groups, F.col("vec_id") == F.col("node"), "left")
    of_class = of_class.select(F.col("vec_id").alias("rep"), (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "vec_id").alias("component"))
    of_class = staged(of_class.join(classes.select(F.col("vec_id").alias("rep"), "h1", "h2"), "rep").select("h1", "h2", "n_links", "component"), "of_class")
    of_vector = single.select("vec_id", "h1", "h2").join(of_class, ["h1", "h2"]).select("vec_id", "n_links", "component")
    drop_staged(classes, described, found)
    out = rows.select("vec_id").join(of_vector, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
