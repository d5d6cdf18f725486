"""Tables staged in the folder that all executors share, to cut lineage between steps of a job."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: With this set, the files of a query's shuffles go when it ends, and don't wait until the driver collects its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Used only where the master is local, so that driver and executor are one process.
LOCAL_DIR = "/tmp/checkpoints/citeweave"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local folder if the master is local, else an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    master = spark.conf.get("spark.master", "")
    if master.startswith("local") and not master.startswith("local-cluster"):
        return LOCAL_DIR
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def run_folder(spark: SparkSession) -> str:
    """The folder of all tables staged by this application."""
    return f"{shared_dir(spark)}/citeweave-{spark.sparkContext.applicationId}"


#: Paths of the tables staged inside each open scratch(), the innermost last.
_SCRATCH: list[list[str]] = []


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table survives lost executors, and a join on it sees a plain exchange, so adaptive
    execution can split skewed partitions.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")  # nothing reads them again: the table is read instead
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables staged inside are deleted at the end, but for those staged by the function that this yields."""
    _SCRATCH.append(held := [])
    kept: list[str] = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        out = staged(df, label)
        kept.append(held.pop())
        return out

    try:
        yield keep
    finally:
        _SCRATCH.pop()
        if _SCRATCH:
            _SCRATCH[-1] += kept
        for path in held:
            _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(*tables: DataFrame) -> None:
    """Delete the files of tables made by staged() that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def drop_run(spark: SparkSession) -> None:
    """Delete all tables that this application has staged; call it once the results are written."""
    _delete(spark, run_folder(spark))
