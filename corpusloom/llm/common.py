"""Helpers shared by the operators: input cleaning, size-checked broadcasts, cuts of lineage."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a key table is broadcast; beyond, the same join shuffles.
BROADCAST_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is missing and Spark runs in one process (tests, local runs) a temporary folder is
    made and set; on a cluster that is an error, as a folder of one machine can't be shared.
    """
    prepare(spark)
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def prepare(spark: SparkSession) -> None:
    """Arrow batches of documents, not of numbers: fewer rows each, if the session has the default number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/corpusloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``scratch`` named."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that ``written`` gave, once nothing reads it any more."""
    files = df.inputFiles()
    if files:
        drop_path(df.sparkSession, files[0].rpartition("/")[0])


def release() -> None:
    """Give memory that is free back to the system, so that idle Python workers hold little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def in_python(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` whose workers release their memory at the end of a task."""

    def released(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(released, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(docs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """``docs`` without the rows whose ``row_key`` of ``columns`` and doc_id are in ``rows`` (key, doc_id).

    The doc_id is compared as well, so rows of equal keys but different content stay.
    """
    key, own = fresh(docs, "_key", "_own")
    gone = rows.select(F.col("key").alias(key), F.col("doc_id").alias(own)).distinct()
    return docs.join(small(gone), (row_key(*columns) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(own)), "left_anti")


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    system, hadoop = _file_system(spark, path)
    return system.exists(hadoop)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it doesn't exist."""
    system, hadoop = _file_system(spark, path)
    return [s.getPath().getName() for s in system.listStatus(hadoop)] if system.exists(hadoop) else []


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else unmarked (the join then shuffles)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def row_key(*columns: str) -> Column:
    """64-bit key of a row's content; equal rows have equal keys and nulls are values of their own."""
    parts: list[Column] = []
    for name in columns:
        parts += [F.col(name).isNull().cast("int"), F.col(name)]
    return F.xxhash64(*parts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
