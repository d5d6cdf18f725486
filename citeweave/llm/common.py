"""Helpers shared by the text operators."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from citeweave.staging import drop_staged, scratch, staged

__all__ = ["arrow_rows", "documents", "drop_staged", "mix64", "positioned", "scratch", "staged"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows at most for the plans that are run inside, so that texts of any usual length stay small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit integers (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def positioned(df: DataFrame, order: list[Column], number: str, group: str | None = None) -> DataFrame:
    """The rows with their position, from 0, in an order; with ``group``, a column that the order begins with, in each group.

    Ranges of rows are sorted and counted apart, and each range's start is added up from the counts of those before it,
    so no task ever holds a whole group. A null group is a group of its own. Rows equal in all of ``order`` lie in one
    range: end the order with a column that tells them apart where there may be very many.
    """
    spread = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "spread")
    by = [group] if group else []
    ranges = spread.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row for each range, not each row
    starts = ranges.select(F.col("_part").alias("_range"), *[F.col(c).alias("_group") for c in by], "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    on = F.col("_part") == F.col("_range")
    joined = spread.join(starts, on & F.col(group).eqNullSafe(F.col("_group")) if group else on)
    return joined.select(*df.columns, (F.col("_start") + F.col("_at") - F.col("_first")).alias(number))
