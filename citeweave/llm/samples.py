"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.language_id import in_fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, bound: int) -> DataFrame:
    """At most ``bound`` labelled documents outside the held-out fold: doc_id, text, label (0 or 1).

    The labels with the smallest id hashes are taken, so the broadcast side has at most ``bound`` short rows and
    the documents aren't shuffled. Of contradicting labels of one document the smaller counts.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold("doc_id", folds, held_out))
    chosen = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")
