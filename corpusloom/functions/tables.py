"""Cuts of lineage and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which ``small`` broadcasts a table.
ROWS = 1_000_000


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the session's checkpoint folder, which all executors share.

    Where none is set and Spark runs in one process (tests, local runs) a temporary folder is; on a cluster that is
    an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def small(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else unmarked (the join then shuffles). What is
    expensive to count should be ``cut`` before."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def exists(df: DataFrame) -> bool:
    """Whether there is a row; the scan ends at the first."""
    return not df.isEmpty()
