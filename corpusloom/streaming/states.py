"""Streaming counterparts: link states, per-origin reservations and windowed activity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "url string, kind int, last_kind int, recrawl boolean, is_seed boolean, ts timestamp, events long"
_STATE = "kind int, last_kind int, recrawl boolean, is_seed boolean, ts timestamp, events long"


def _flag(value) -> bool | None:
    return None if value is None or pd.isna(value) else bool(value)


def fold_states(events: DataFrame) -> DataFrame:
    """Current state of each url after every micro-batch (update mode), by the arrival-order fold.

    ``events``: url, seq, ts, kind, recrawl, is_seed. Within a batch rows are taken in order of ``seq``; a row that
    isn't later than the state is dropped.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        kind, last, recrawl, seed, ts, n = state.get if state.exists else (None, None, None, None, None, 0)
        for r in rows.itertuples():
            n += 1
            if ts is not None and not r.ts > pd.Timestamp(ts):
                continue
            last = int(r.kind) if kind is None else kind
            kind, ts = int(r.kind), r.ts
            recrawl = recrawl if _flag(r.recrawl) is None else _flag(r.recrawl)
            seed = seed if _flag(r.is_seed) is None else _flag(r.is_seed)
        state.update((kind, last, recrawl, seed, pd.Timestamp(ts).to_pydatetime(), n))
        yield pd.DataFrame({"url": [key[0]], "kind": [kind], "last_kind": [last], "recrawl": [recrawl], "is_seed": [seed], "ts": [pd.Timestamp(ts)], "events": [n]})

    return events.groupBy("url").applyInPandasWithState(update, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def activity(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows; rows later than the watermark are dropped."""
    kept = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = kept.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def crawl_rounds(frontier: DataFrame, links: DataFrame, rounds: int, checkpoint_every: int = 4) -> DataFrame:
    """(url, round): urls reached from ``frontier`` (url) over ``links`` (src, dst) in breadth-first rounds.

    Lineage is cut in the session's checkpoint folder every few rounds.
    """
    seen = frontier.select("url").distinct().withColumn("round", F.lit(0))
    front = seen
    for number in range(1, rounds + 1):
        reached = front.select(F.col("url").alias("src")).join(links, "src").select(F.col("dst").alias("url")).distinct()
        front = reached.join(seen.select("url"), "url", "left_anti").withColumn("round", F.lit(number))
        if number % checkpoint_every == 0 and frontier.sparkSession.sparkContext.getCheckpointDir():
            front = front.checkpoint()
        seen = seen.unionByName(front)
        if number % checkpoint_every == 0 and frontier.sparkSession.sparkContext.getCheckpointDir():
            seen = seen.checkpoint()
    return seen
