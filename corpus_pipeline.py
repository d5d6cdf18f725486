"""The corpus pipeline: quality, exact copies, near copies, personal data, packing.

Each stage reads what the one before it wrote and takes effect on the documents; the last returns the packed
pieces of what is left.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import drop_staged, scratch, staged
from citeweave.llm.exact_dedup import exact_dedup
from citeweave.llm.jaccard_join import similar_components
from citeweave.llm.packing import packed_documents
from citeweave.llm.pii import masked
from citeweave.llm.quality import ACCEPT, learn, score_documents

#: Near copies in the pipeline: five-word shingles, a similarity of 0.8 or more.
NEAR_WORDS, NEAR_SHARE = 5, (80, 100)


def _free_name(docs: DataFrame, wanted: str) -> str:
    """The wanted name, lengthened until no column of the documents has it."""
    taken = {c.lower() for c in docs.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking, learned from the labels of these documents, accepts.

    Every row is judged by its own text, null as empty, whatever its id; repeated rows share their fate. All columns stay
    as they are. Without usable labels nothing is ranked and all rows get one score.
    """
    ranking = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _free_name(docs, "score")
    return score_documents(docs, ranking, score_col=score).where(F.col(score) >= ACCEPT).drop(score)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number of their own in order of doc_id (null last) and text, and that column's name.

    Where each row has an id of its own, that is the number; else the rows are sorted and counted.
    """
    number = _free_name(docs, "row")
    rows, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows == ids:
        return docs.withColumn(number, F.col("doc_id")), number
    return staged(docs.orderBy(F.col("doc_id").asc_nulls_last(), "text").withColumn(number, F.monotonically_increasing_id()), "numbered"), number


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space.

    Rows are judged one by one, whatever their ids: the longest text stays, then the smallest id, a null id last. Of
    rows repeated with one id and text one stays; different texts of one id, or without an id, are different documents.
    """
    rows, number = _numbered(docs)
    with scratch(spark) as keep:
        kept = keep(exact_dedup(rows, id_col=number).where("kept").select(F.col("doc_id").alias(number)), "kept")
    return rows.join(kept.hint("merge"), number, "left_semi").select(docs.columns)  # ids grow with the data: never broadcast


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near copies.

    Rows are judged one by one: a null id is larger than all others, and of one id's rows, or those without an id, that
    are near copies of each other the first text in order stays. Null and wordless texts are no copies of anything.
    """
    rows, number = _numbered(docs)
    with scratch(spark) as keep:
        found = similar_components(rows, NEAR_WORDS, NEAR_SHARE, id_col=number)
        kept = keep(found.where("component_id = doc_id").select(F.col("doc_id").alias(number)), "kept")
    return rows.join(kept.hint("merge"), number, "left_semi").select(docs.columns)  # ids grow with the data: never broadcast


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; null stays null.

    Where the documents have a column n_chars, it counts the new text; all else stays, whatever ids and repeated rows.
    """
    out = masked(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; null text is empty, every row is packed by itself."""
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", drop_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: No SQL: the quality ranking, the random field and the tokenizer are learned or compiled. The stages are tested
#: one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            drop_staged(before)
    return STAGES[-1][1](spark, docs, sf_dir)
