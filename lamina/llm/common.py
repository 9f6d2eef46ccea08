"""Pieces that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1000
_OWN_DIR: dict[str, str] = {}
_SCOPES: list[list[str]] = []  # of each open scratch() the folders staged in it


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Only a local master may go without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="lamina-")
    return _OWN_DIR[app]


def staged(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back: cuts lineage, survives lost executors and
    is computed once however often it is used. release() removes what an application has staged."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lamina-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(make: Callable[[], DataFrame]) -> DataFrame:
    """make(), whose last act must be to stage the frame that it returns. What it staged before is removed: that frame is written and
    doesn't need it any more."""
    _SCOPES.append([])
    try:
        made = make()
    finally:
        own = _SCOPES.pop()
    for path in own[:-1]:
        _remove(made.sparkSession, path)
    if _SCOPES:
        _SCOPES[-1].append(own[-1])
    return made


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of BATCH_ROWS, unless the session has a number of its own: Spark's default of 10,000 documents takes some
    hundred megabytes outside the heap of every executor, for buffers on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work, for mapInArrow and mapInPandas, that gives memory back to the system at the end of a task: workers stay, and what one operator
    has freed would still count against the next."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            trim()

    return run


def trim() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Removes what is left: call it when the results have been written."""
    _remove(spark, f"{shared_dir(spark)}/lamina-{spark.sparkContext.applicationId}")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3


def held_out(doc_id: str = "doc_id") -> Column:
    return fold(doc_id) == 1
