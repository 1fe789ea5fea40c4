"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows and bytes of one Arrow batch handed to a Python worker.  Two workers
#: share an executor, so a batch must stay a small part of its memory.
BATCH_ROWS = 1000
BATCH_BYTES = "16m"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches, so that long documents cannot fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def text_of(column: str = "text") -> Column:
    """A text column; null counts as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def held_out(column: str = "doc_id") -> Column:
    """The rows no model may learn from."""
    return id_crc(column) % 4 == 2


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, from spark.checkpoint.dir.

    Where the setting is absent or empty a temporary folder is made if all of
    Spark runs on this machine; elsewhere executors would not see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        folder = f"file://{tempfile.mkdtemp(prefix='skyloom-')}"
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage: write to the shared folder once, read from there.

    The copy outlives executors; it is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/skyloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove a stored() copy that no pending plan reads."""
    for path in df.inputFiles()[:1]:
        for entry in list(_written):
            name = entry[1].rsplit("/", 1)[1]
            if f"/{name}/" in path:
                _written.remove(entry)
                _remove(*entry)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended: nothing is left to ask
            return
