"""Link states: an append-only log of events folded to the current state of every url."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DISCOVERED, RESERVED, CRAWLED, STORED, ERROR = 0, 1, 2, 3, 32
KINDS = {DISCOVERED: "Discovered", RESERVED: "ReservedForCrawl", CRAWLED: "Crawled", STORED: "ProcessedAndStored", ERROR: "InternalError"}


def is_significant(kind: Column) -> Column:
    return kind <= STORED


def kept_events(log: DataFrame, key: str = "url") -> DataFrame:
    """Events that the fold accepts: later than every one that arrived before.

    The fold isn't associative, so it must not be combined in parts; windows in order of arrival (``seq``)
    give it exactly, with one shuffle by key.
    """
    arrival = Window.partitionBy(key).orderBy("seq")
    before = F.max("ts").over(arrival.rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("_before", before).filter("_before is null or ts > _before").drop("_before")


def fold(log: DataFrame, key: str = "url", carried: tuple[str, ...] = (), significant_only: bool = False) -> DataFrame:
    """One row for each key: kind, ts and ``carried`` columns of the last kept event, the kind before it, and
    the last flags ``recrawl`` and ``is_seed`` that were set.

    With ``significant_only`` the kind before counts only if it is significant.
    """
    arrival = Window.partitionBy(key).orderBy("seq")
    so_far = arrival.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.lag("kind").over(arrival)
    if significant_only:
        significant = F.when(is_significant(F.col("kind")), F.col("kind"))
        last = F.last(significant, ignorenulls=True).over(arrival.rowsBetween(Window.unboundedPreceding, -1))
    flags = [F.last(c, ignorenulls=True).over(so_far).alias(c) for c in ("recrawl", "is_seed")]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))
    rows = kept_events(log, key).select(key, "kind", F.coalesce(last, F.col("kind")).alias("last_kind"), *flags, "ts", *carried, rank.alias("_rank"))
    return rows.filter("_rank = 1").drop("_rank")


def counts(states: DataFrame) -> DataFrame:
    return states.groupBy("kind").agg(F.count("*").alias("n"))


def to_recover(states: DataFrame) -> DataFrame:
    """States that a restart must enter into the frontier again."""
    return states.filter(F.col("kind") != STORED)


def to_recrawl(states: DataFrame) -> DataFrame:
    return states.filter(F.coalesce("recrawl", F.lit(False)))


def last_access(log: DataFrame, key: str = "origin") -> DataFrame:
    return log.groupBy(key).agg(F.max("ts").alias("last_access"))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key (last write wins)."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
