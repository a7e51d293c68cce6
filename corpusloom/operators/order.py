"""Numbers of rows in a total order, without a task that holds all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.tables import cut


def numbered(df: DataFrame, *keys: str, name: str = "seq") -> DataFrame:
    """``df`` with the number, from 1, of each row in the order of ``keys`` (ties in any order).

    Rows are sorted in ranges; the number is that within the range after the rows of the ranges before it. Only the
    sizes of the ranges, one a partition, are gathered.
    """
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = cut(ranged.select("*", F.spark_partition_id().alias("_range"), (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1).alias("_place")))
    sizes, offsets, before = ranged.groupBy("_range").agg(F.count("*").alias("n")).collect(), [], 0
    for row in sorted(sizes):
        offsets.append((row[0], before))
        before += row.n
    table = df.sparkSession.createDataFrame(offsets, "_range int, _before long")
    return ranged.join(F.broadcast(table), "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")
