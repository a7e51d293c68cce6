"""Substring deduplication (operator 3): a log-structured index of window hashes, kept from batch to batch.

Every document is reduced to anchors: of the hashes of its windows of ``WINDOW`` words, the least of each
``MIN_WORDS - WINDOW + 1`` neighbours. Any run of ``MIN_WORDS`` words that two documents share has an anchor
in common. The index is a list of runs, immutable tables sorted and bucketed by hash that hold where each
anchor was seen first. The anchors of a new batch are combined by hash, partitioned and sorted alike and
merge-joined with every run; those that no run has become a new run, and ``FANOUT`` runs are compacted into one by
merging them bucket by bucket. An index in a folder stays: ``add_documents`` of a later session checks new documents
against all earlier ones. Matches are verified on the words of both documents and extended to maximal equal runs; those of ``MIN_WORDS`` or more
are reported. What an anchor's first document lacks, another earlier one may have: of the documents with recurring
anchors, every run of ``MIN_WORDS`` words whose least anchor recurs is hashed as well, and the first document with the
same run is its source. No pair of documents is formed for that; a kept index keeps the hashes of these runs.

Defined results
    * words are compared without case and punctuation; texts of fewer than ``MIN_WORDS`` words have no repeat
    * the first document (batches in order, then doc_id, null last) that has an anchor, or a run, is its source; repeats
      are those of later documents, so a passage stays once; repeats within a document don't count
    * rows equal in doc_id and text are one document; null and empty texts have no repeats
    * one row for each document with a repeat: its repeated words and merged spans of word numbers
    * an empty table gives an empty result and an empty run; very long texts are indexed whole; equal places (ties)
      are one; columns of other names, whatever they are, aren't read
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import common, text

MIN_WORDS = 50
WINDOW = 25
BATCHES = 4
FANOUT = 3


def _sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """Least (or greatest) of each ``width`` neighbours, by doubling."""
    if len(values) < width:
        return values[:0]
    have, out = 1, values
    while 2 * have <= width:
        out = least(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return least(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(w: text.Words, window: int = WINDOW, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word within it, hash) of the anchors of a chunk."""
    hashes = text.windows(w.hash, window)
    none = np.empty(0, np.int64)
    if not len(hashes):
        return none, none, np.empty(0, np.uint64)
    top = np.uint64(2**64 - 1)
    doc = w.doc
    hashes = np.where(doc[: len(hashes)] == doc[window - 1 :], np.minimum(hashes, top - np.uint64(1)), top)
    near = least - window + 1
    # places beyond the ends are neighbours too, so that the last windows of the chunk have theirs
    padded = np.concatenate([np.full(near - 1, top), hashes, np.full(near - 1, top)])
    lows = _sliding(padded, near, np.minimum)
    chosen = np.flatnonzero((hashes == _sliding(lows, near, np.maximum)) & (hashes != top))
    enough = np.diff(w.first)[doc[chosen]] >= least
    chosen = chosen[enough]
    return doc[chosen], chosen - w.first[doc[chosen]], hashes[chosen]


def anchor_table(docs: DataFrame) -> DataFrame:
    """(key, doc_id, batch, word, hash) of ``docs`` (key, doc_id, batch, text)."""

    def find(batches):
        for batch in batches:
            for chunk in text.chunks(batch.column("text")):
                doc, word, hashes = anchors(text.words(chunk))
                rows = pa.array(doc + chunk.rows.start)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(rows), batch.column("doc_id").take(rows), batch.column("batch").take(rows), pa.array(word.astype(np.int32)), pa.array(hashes.view(np.int64))], names=["key", "doc_id", "batch", "word", "hash"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.in_python(docs.select("key", "doc_id", "batch", "text"), find, f"key long, doc_id {kind}, batch int, word int, hash long")


class WindowIndex:
    """Runs of first places by anchor hash; each run is a table bucketed and sorted by hash.

    With a ``folder``, which all executors must share, the index stays: a manifest there names its runs and the texts
    of its documents, and ``WindowIndex(spark, folder)`` of a later session goes on with them. A manifest is written
    after what it names, so a session that breaks off leaves the one before.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None, fanout: int = FANOUT) -> None:
        self.spark, self.folder, self.fanout = spark, folder and folder.rstrip("/"), fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[str, str]] = []
        self.compacted: list[tuple[str, str]] = []
        self.texts: list[str] = []
        self.windows: list[str] = []
        self.least: int | None = None
        self.version = 0
        for version in sorted(self._versions(), reverse=True):
            path = f"{self.folder}/manifest-{version}"
            if common.exists(spark, f"{path}/_SUCCESS"):
                self.version = version
                rows = spark.read.parquet(path).orderBy("number").collect()
                self.buckets = next((r.buckets for r in rows if r.kind == "run"), self.buckets)
                self.texts = [r.path for r in rows if r.kind == "texts"]
                kept = [r for r in rows if r.kind == "windows"]
                if len(kept) != len(self.texts):
                    raise ValueError(f"{self.folder} was written without the runs of its documents; it must be built anew")
                self.windows, self.least = [r.path for r in kept], int(kept[0].columns) if kept else None
                self.runs = [(self._attach(r.path, r.columns), r.path) for r in rows if r.kind == "run"]
                break

    def _versions(self) -> list[int]:
        names = common.listed(self.spark, self.folder) if self.folder else []
        return [int(n.removeprefix("manifest-")) for n in names if n.removeprefix("manifest-").isdigit()]

    def _attach(self, path: str, columns: str) -> str:
        """Name of a table over a run that an earlier session wrote."""
        name = f"corpusloom_run_{uuid.uuid4().hex}"
        self.spark.sql(f"create table {name} ({columns}) using parquet clustered by (hash) sorted by (hash) into {self.buckets} buckets location '{path}'")
        return name

    def _path(self, kind: str) -> str:
        return f"{self.folder}/{kind}-{uuid.uuid4().hex}" if self.folder else common.scratch(self.spark, kind)

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        """Write rows that are partitioned by hash as a bucketed, sorted table."""
        name, path = f"corpusloom_run_{uuid.uuid4().hex}", self._path("run")
        rows.write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", path).format("parquet").saveAsTable(name)
        return name, path

    def keep_texts(self, docs: DataFrame) -> None:
        """Keep the texts of ``docs`` (key, text): later batches are verified against them."""
        path = self._path("texts")
        docs.select("key", "text").write.parquet(path)
        self.texts.append(path)

    def keep_windows(self, rows: DataFrame, least: int) -> None:
        """Keep the first places of hashed runs (window, place) of ``least`` words."""
        path = self._path("windows")
        rows.write.parquet(path)
        self.windows.append(path)
        self.least = least

    def commit(self) -> None:
        """Write a manifest of what the index holds now."""
        columns = lambda name: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.table(name).schema)
        rows = [(k, "run", path, self.buckets, columns(name)) for k, (name, path) in enumerate(self.runs)]
        rows += [(len(self.runs) + k, "texts", path, self.buckets, None) for k, path in enumerate(self.texts)]
        rows += [(len(rows) + k, "windows", path, self.buckets, str(self.least)) for k, path in enumerate(self.windows)]
        self.version += 1
        self.spark.createDataFrame(rows, "number int, kind string, path string, buckets int, columns string").coalesce(1).write.parquet(f"{self.folder}/manifest-{self.version}")

    def add(self, batch: DataFrame) -> DataFrame:
        """(hash, key, doc_id, word, source) of the anchors of ``batch`` that an earlier document has; indexes the rest.

        ``source`` is the struct (doc_id, key, word) of the first place. An anchor's places are combined before they
        are shuffled; only anchors that recur are joined with their places again.
        """
        if len(self.runs) >= self.fanout:
            self.compact()
        place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "word")
        rows = batch.groupBy("hash").agg(F.min(place).alias("first"), F.min("key").alias("low"), F.max("key").alias("high"))
        known = [F.col(f"run{number}") for number in range(len(self.runs))]
        for number in range(len(self.runs)):
            rows = rows.join(self.spark.table(self.runs[number][0]).select("hash", F.col("place").alias(f"run{number}")).hint("merge"), "hash", "left")
        found = F.coalesce(*known, F.lit(None)) if known else F.lit(None)
        rows = common.written(rows.select("hash", "first", F.coalesce(*known, "first").alias("source"), found.isNull().alias("new"), (F.col("low") != F.col("high")).alias("shared")), "places")
        self.runs.append(self._write(rows.filter("new").select("hash", F.col("first").alias("place")).repartition(self.buckets, "hash")))
        recurring = common.written(rows.filter("shared or not new").select(F.col("hash").alias("_hash"), "source"), "recurring")
        common.discard(rows)
        matches = batch.join(common.small(recurring), F.col("hash") == F.col("_hash")).filter(F.col("key") != F.col("source.key"))
        return common.written(matches.select("hash", "key", "doc_id", "word", "source"), "matches")

    def compact(self) -> None:
        """Merge all runs into one. An anchor is in one run only, so nothing is compared; nothing is shuffled."""
        run = lambda number, name: self.spark.table(self.runs[number][0]).select("hash", F.col("place").alias(name))
        merged = run(0, "place")
        for number in range(1, len(self.runs)):
            merged = merged.join(run(number, "other").hint("merge"), "hash", "full").select("hash", F.coalesce("place", "other").alias("place"))
        old, self.runs = self.runs, [self._write(merged)]
        if self.folder:
            self.compacted += old
        else:
            self._drop(old)

    def close(self) -> None:
        """End the session's use of a kept index: a manifest is written, runs that were compacted and old manifests go."""
        self.commit()
        for version in self._versions():
            if version < self.version:
                common.drop_path(self.spark, f"{self.folder}/manifest-{version}")
        self._drop(self.compacted)
        for name, _ in self.runs:
            self.spark.sql(f"drop table if exists {name}")
        self.runs, self.compacted = [], []

    def drop(self) -> None:
        """Delete all runs and texts."""
        self._drop(self.runs + self.compacted)
        for path in self.texts + self.windows:
            common.drop_path(self.spark, path)
        for version in self._versions():
            common.drop_path(self.spark, f"{self.folder}/manifest-{version}")
        self.runs, self.compacted, self.texts, self.windows = [], [], [], []

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"drop table if exists {name}")
            common.drop_path(self.spark, path)


def equal_runs(a: np.ndarray, b: np.ndarray, shift: int, least: int) -> list[tuple[int, int]]:
    """Maximal runs of at least ``least`` words in which ``a[i] == b[i - shift]``, as (start, end) in ``a``."""
    lo, hi = max(0, shift), min(len(a), len(b) + shift)
    if hi - lo < least:
        return []
    breaks = np.concatenate([[-1], np.flatnonzero(a[lo:hi] != b[lo - shift : hi - shift]), [hi - lo]])
    long = np.flatnonzero(np.diff(breaks) > least)
    return [(int(breaks[i]) + 1 + lo, int(breaks[i + 1]) + lo) for i in long]


def window_table(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(window, key, doc_id, start, old): the runs of ``least`` words of ``docs`` (key, doc_id, old, text, hashes) whose
    least anchor is one of ``hashes``, which a document shares with others."""

    def find(batches):
        top = np.uint64(2**64 - 1)
        for batch in batches:
            lists = batch.column("hashes")
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            every = lists.flatten().to_numpy().view(np.uint64)
            for chunk in text.chunks(batch.column("text")):
                w = text.words(chunk)
                whole = text.windows(w.hash, least)
                if not len(whole):
                    continue
                parts, doc = np.minimum(text.windows(w.hash, WINDOW), top - np.uint64(1)), w.doc
                at = chunk.rows.start
                owner = np.repeat(np.arange(chunk.n), np.diff(ends[at : at + chunk.n + 1])).astype(np.uint64)
                shared = text.mix(every[ends[at] : ends[at + chunk.n]] ^ text.mix(owner + np.uint64(1)))
                mask = np.isin(text.mix(parts ^ text.mix(doc[: len(parts)].astype(np.uint64) + np.uint64(1))), shared)
                near = least - WINDOW + 1
                lows = _sliding(np.where(mask, parts, top), near, np.minimum)
                chosen = np.flatnonzero((lows == _sliding(parts, near, np.minimum)) & (lows != top) & (doc[: len(whole)] == doc[least - 1 :]))
                rows = pa.array(doc[chosen] + at)
                start = pa.array((chosen - w.first[doc[chosen]]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(whole[chosen].view(np.int64)), *(batch.column(c).take(rows) for c in ("key", "doc_id")), start, batch.column("old").take(rows)], names=["window", "key", "doc_id", "start", "old"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.in_python(docs.select("key", "doc_id", "old", "text", "hashes"), find, f"window long, key long, doc_id {kind}, start long, old boolean")


def shared_windows(matches: DataFrame, texts: DataFrame, least: int, index: WindowIndex | None) -> DataFrame:
    """(key, doc_id, start, end, source_id) of the runs that an earlier document has, whichever it is.

    Of a run's places that of an ``old`` text comes first, as it is the first that has the run's anchor, then the one
    that ``index`` keeps, then those of new texts; the index keeps the first places of new runs.
    """
    places = matches.select("key", "doc_id", "hash").union(matches.select("source.key", "source.doc_id", "hash"))
    places = places.groupBy("key", "doc_id").agg(F.collect_set("hash").alias("hashes"))
    rows = window_table(texts.join(places, "key"), least)
    place = F.struct(F.when(F.col("old"), 0).otherwise(2).alias("age"), F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    rows = rows.select("window", "start", place.alias("place"))
    if index is not None:
        rows = common.written(rows, "windows")
        if index.windows:
            known = index.spark.read.parquet(*index.windows)
            rows = rows.union(known.select("window", F.lit(None).cast("long"), F.struct(F.lit(1).alias("age"), "place.none", "place.doc_id", "place.key")))
        firsts = rows.groupBy("window").agg(F.min("place").alias("place"), F.max(F.col("place.age") == 1).alias("known"))
        index.keep_windows(firsts.filter("not known").select("window", "place"), least)
    rows = rows.withColumn("first", F.min("place").over(Window.partitionBy("window"))).filter("place.age = 2 and place.key <> first.key")
    rows = rows.select("place.key", "place.doc_id", "start", F.col("first.doc_id").alias("source_id"))
    island = F.col("start") - F.row_number().over(Window.partitionBy("key", "source_id").orderBy("start"))
    spans = rows.withColumn("island", island).groupBy("key", "doc_id", "source_id", "island").agg(F.min("start").alias("start"), (F.max("start") + least).alias("end"))
    return common.written(spans.select("key", "doc_id", "start", "end", "source_id"), "spans")


def verified(matches: DataFrame, docs: DataFrame, least: int = MIN_WORDS, index: WindowIndex | None = None) -> DataFrame:
    """(key, doc_id, start, end, source_id) of the maximal equal runs on the diagonals of ``matches``, and of all runs of
    ``least`` words that any other earlier document has (``shared_windows``)."""
    spark = matches.sparkSession
    source = [F.col("source.key").alias("source_key"), F.col("source.doc_id").alias("source_id")]
    pairs = matches.groupBy("key", "doc_id", *source).agg(F.collect_set(F.col("word") - F.col("source.word")).alias("shifts"))
    pairs = common.written(pairs, "pairs")
    wanted = pairs.select("key").union(pairs.select("source_key")).distinct()
    wanted = common.written(wanted.withColumnRenamed("key", "_wanted"), "wanted")
    old = F.col("old") if "old" in docs.columns else F.lit(False)
    texts = docs.join(common.small(wanted), F.col("key") == F.col("_wanted"), "left_semi").select("key", "text", old.alias("old")).dropDuplicates(["key"])
    # bucketed by key, so that of both joins only pairs and the sources' texts are shuffled
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"corpusloom_texts_{uuid.uuid4().hex}", common.scratch(spark, "texts")
    texts.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").option("path", path).format("parquet").saveAsTable(name)
    texts = spark.table(name)
    both = pairs.join(texts.select(F.col("key").alias("source_key"), F.col("text").alias("source_text")), "source_key").join(texts, "key")

    def compare(batches):
        for batch in batches:
            rows, start, end = [], [], []
            ours, theirs = batch.column("text"), batch.column("source_text")
            shifts = batch.column("shifts").to_pylist()
            for chunk in text.chunks(ours):
                mine = text.words(chunk)
                part = theirs.slice(chunk.rows.start, chunk.n)
                for other in text.chunks(part):
                    source = text.words(other)
                    for k in range(other.n):
                        d = other.rows.start + k
                        a = mine.hash[mine.first[d] : mine.first[d + 1]]
                        b = source.hash[source.first[k] : source.first[k + 1]]
                        row = chunk.rows.start + d
                        for shift in shifts[row]:
                            for lo, hi in equal_runs(a, b, shift, least):
                                rows.append(row)
                                start.append(lo)
                                end.append(hi)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("key", "doc_id")), pa.array(start, pa.int64()), pa.array(end, pa.int64()), batch.column("source_id").take(take)], names=["key", "doc_id", "start", "end", "source_id"])

    kind = matches.schema["doc_id"].dataType.simpleString()
    runs = common.in_python(both.select("key", "doc_id", "text", "source_id", "source_text", "shifts"), compare, f"key long, doc_id {kind}, start long, end long, source_id {kind}")
    runs = common.written(runs, "spans").union(shared_windows(matches, texts, least, index))
    spark.sql(f"drop table if exists {name}")
    common.drop_path(spark, path)
    return runs


def _order(docs: DataFrame):
    """A number in the order of doc_id: its value, or that of the first bytes of a text."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, T.NumericType):
        return F.col("doc_id").cast("double")
    start = F.rpad(F.substring(F.hex(F.encode(F.col("doc_id").cast("string"), "utf-8")), 1, 12), 12, "0")
    return F.conv(start, 16, 10).cast("double")


def _merged(spans: DataFrame) -> DataFrame:
    merged = """aggregate(array_sort(collect_set(struct(start, end))), cast(array() as array<struct<start:bigint,end:bigint>>),
        (a, x) -> if(size(a) > 0 and x.start <= element_at(a, -1).end,
            concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))),
            concat(a, array(x))))"""
    grouped = spans.groupBy("key", "doc_id").agg(F.expr(merged).alias("spans"), F.array_sort(F.collect_set("source_id")).alias("sources"))
    words = F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)")
    return grouped.select("doc_id", words.alias("repeated_words"), "sources", "spans")


def add_documents(index: WindowIndex, docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """As ``repeated_passages`` for a new batch of documents, against all that ``index`` holds and each other; the
    batch is added to the index and a manifest written. Rows that the index has already repeat nothing."""
    if index.least not in (None, least):
        raise ValueError(f"the index keeps runs of {index.least} words")
    source = docs.select(common.row_key("doc_id", "text").alias("key"), "doc_id", "text")
    texts = index.spark.read.parquet(*index.texts) if index.texts else None
    table = common.written(anchor_table(source.withColumn("batch", F.lit(0))).drop("batch"), "table")
    matches = index.add(table)
    index.keep_texts(source)
    every = source.select("key", "text", F.lit(False).alias("old"))
    every = every if texts is None else every.union(texts.select("key", "text", F.lit(True)))
    found = verified(matches, every, least, index)
    index.commit()
    return _merged(found)


def repeated_passages(docs: DataFrame, batches: int = BATCHES, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, repeated_words, sources, spans) of each document with a passage that an earlier one has.

    ``spans`` are merged (start, end) word numbers, ``sources`` the sorted doc_ids of the earlier documents.
    ``docs`` is indexed in ``batches`` batches in order of doc_id.
    """
    spark = docs.sparkSession
    source = docs.select(common.row_key("doc_id", "text").alias("key"), "doc_id", "text")
    place = _order(docs)
    cuts = source.agg(F.percentile_approx(place, [k / batches for k in range(1, batches)])).first()[0] or []
    batch = sum((F.coalesce(place > cut, F.lit(False)).cast("int") for cut in cuts), F.lit(0))
    batch = F.when(F.col("doc_id").isNull(), batches - 1).otherwise(batch)
    path = common.scratch(spark, "table")
    anchors_ = anchor_table(source.withColumn("batch", batch.cast("int")))
    anchors_.write.partitionBy("batch").parquet(path)
    table = spark.read.schema(anchors_.schema).parquet(path)
    index = WindowIndex(spark)
    matches: DataFrame | None = None
    for number in range(batches):
        found = index.add(table.filter(F.col("batch") == number).drop("batch"))
        matches = found if matches is None else matches.union(found)
    common.drop_path(spark, path)
    index.drop()
    return _merged(verified(matches, source, least))
