"""The registered queries of the text operators, each over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from citeweave.llm.bpe import encoding_digests
from citeweave.llm.common import documents
from citeweave.llm.embedding_dedup import near_duplicates
from citeweave.llm.exact_dedup import EXACT_DEDUP_SQL, exact_dedup
from citeweave.llm.importance_resampling import RESAMPLING_SQL, resampled
from citeweave.llm.jaccard_join import similar_components
from citeweave.llm.language_id import language_predictions
from citeweave.llm.merkle import MERKLE_SQL, verified_manifest
from citeweave.llm.packing import packed_documents
from citeweave.llm.piece_codec import piece_digests
from citeweave.llm.pii import personal_data
from citeweave.llm.quality import quality_scores
from citeweave.llm.substring_dedup import repeated_passages
from citeweave.llm.toxicity import toxicity_scores


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_predictions(documents(spark, sf_dir))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, spaced=True)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_manifest(documents(spark, sf_dir))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_language_id, op2_jaccard_join, op3_substring_dedup, op4_quality, op5_bpe_codec, op6_embedding_dedup, op7_exact_dedup, op8_toxicity, op9_packing, op10_pii, op11_sentencepiece, op12_merkle_manifest, op13_importance_resampling]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": EXACT_DEDUP_SQL, "op12_merkle_manifest": MERKLE_SQL, "op13_importance_resampling": RESAMPLING_SQL}
