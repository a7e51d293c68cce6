"""Benchmark decontamination (operator 6): latent semantic retrieval, then subsequence and answer checks.

Terms are the words of the benchmark: no other word can count in the checks that follow. One pass over the
text keeps, for each document, the places of those words. All later passes read that compact table:

1. document frequencies of the terms over blocks of ``HALF`` words of the whole corpus;
2. a distributed randomised SVD of the TF-IDF matrix of blocks: every partition adds its part of
   A^T(A W), the driver orthonormalises that matrix (terms x ``RANK`` + oversampling), and a second pass
   adds the small Gram matrix that gives singular values and vectors;
3. windows of two neighbouring blocks are projected and compared by cosine with all pieces of all items. What
   the last check would reject whatever the item, as too few answer words of any item are around, is
   left out before;
4. a window that is close enough must hold the item itself, in order, perhaps with words changed, left out or
   added: longest common subsequence of at least ``SHARE`` of the item's words around the window, and
   ``ANSWER_SHARE`` of its answer, the ``ANSWER`` words of greatest inverse document frequency.

Defined results
    * null and empty texts match nothing; so do items without words; an empty benchmark or table gives no rows
    * items of fewer than ``SHORT`` words are found only in full
    * one row for each row of ``docs`` and item_id that match, the best window's (ties: the earliest);
      rows of ``docs`` equal in doc_id and text are one; of texts with one item_id the best match is given
    * null doc_ids and item_ids are reported as they are
    * very long texts are searched whole; other columns, whatever their names, aren't read by ``contaminated``
      and pass through ``decontaminate``
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common, text

HALF = 16
RANK, OVERSAMPLING = 96, 8
COSINE = 0.2
SHARE, ANSWER, ANSWER_SHARE = 0.6, 5, 0.6
SHORT = 8
#: Terms in more than this share of the blocks have weight 0, unless they are part of an item's answer.
STOP_SHARE = 0.005
#: Items that are worked on at once; a larger benchmark takes several rounds.
ITEMS = 20_000
SLOT_BITS = 22


class Benchmark:
    """Items as sequences of term numbers."""

    def __init__(self, items: pd.DataFrame) -> None:
        self.ids = items.item_id.tolist()
        sequences = [text.words_of((t or "").encode()).hash for t in items.text]
        self.terms = np.unique(np.concatenate(sequences)) if sequences else np.empty(0, np.uint64)
        #: Slots that a term has; another word may share one, so ``find`` decides.
        self.slots = np.zeros(1 << SLOT_BITS, np.bool_)
        self.slots[(self.terms & np.uint64(len(self.slots) - 1)).astype(np.int64)] = True
        self.items = [np.searchsorted(self.terms, s) for s in sequences]

    def weigh(self, df: np.ndarray, blocks: int) -> None:
        raw = np.log((blocks + 1) / (df + 1)).astype(np.float32)
        self.answers, self.masks = [], []
        self.is_answer = np.zeros(len(self.terms), np.bool_)
        for item in self.items:
            unique = np.unique(item)
            best = unique[np.lexsort((unique, -raw[unique]))][:ANSWER]
            self.is_answer[best] = True
            self.answers.append(set(best.tolist()))
            mask: dict[int, int] = {}
            for place, term in enumerate(item.tolist()):
                mask[term] = mask.get(term, 0) | 1 << place
            self.masks.append(mask)
        self.idf = np.where((df <= STOP_SHARE * blocks) | self.is_answer, np.maximum(raw, 1e-3), 0).astype(np.float32)
        #: Answer words that any match has, and how many blocks around one they lie at most.
        self.needed = min((math.ceil(ANSWER_SHARE * len(a)) for a in self.answers), default=1)
        self.around = -(-max(map(len, self.items), default=0) // HALF) + 3

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, terms) of the words of ``hashes`` that are terms."""
        maybe = np.flatnonzero(self.slots[(hashes & np.uint64(len(self.slots) - 1)).astype(np.int64)])
        some = hashes[maybe]
        at = np.minimum(np.searchsorted(self.terms, some), len(self.terms) - 1)
        hit = self.terms[at] == some
        return maybe[hit], at[hit]

    def project(self, basis: np.ndarray) -> None:
        """Unit vectors of the items' pieces of two blocks each."""
        self.embedded = basis * self.idf[:, None]
        vectors, owners = [], []
        for number, item in enumerate(self.items):
            for at in range(0, max(1, len(item) - HALF), HALF):
                vectors.append(self.embedded[item[at : at + 2 * HALF]].sum(0))
                owners.append(number)
        vectors = np.array(vectors, np.float32).reshape(-1, basis.shape[1])
        self.pieces = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        self.owners = np.array(owners)


def subsequence(mask: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence of an item (bit masks of its terms) and ``words``."""
    state = full = (1 << length) - 1
    for word in words:
        m = mask.get(word)
        if m:
            u = state & m
            state = (state + u | state - u) & full
    return length - state.bit_count()


def _hits(docs: DataFrame, shared) -> DataFrame:
    """(key, doc_id, words, terms, gaps): each document's number of words, and numbers and places of the
    benchmark's words among them; a row for each document with a word."""

    def find(batches):
        bench: Benchmark = shared.value
        for batch in batches:
            keep, sizes, terms, gaps = [], [], [], []
            for chunk in text.chunks(batch.column("text")):
                w = text.words(chunk)
                places, number = bench.find(w.hash)
                first = np.searchsorted(places, w.first)
                number = number.astype(np.int32)
                size = np.diff(w.first)
                for d in np.flatnonzero(size):
                    own = slice(first[d], first[d + 1])
                    keep.append(chunk.rows.start + d)
                    sizes.append(int(size[d]))
                    terms.append(number[own].tobytes())
                    gaps.append(np.diff(places[own] - w.first[d], prepend=0).astype(np.int32).tobytes())
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(rows), batch.column("doc_id").take(rows), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(gaps, pa.binary())], names=["key", "doc_id", "words", "terms", "gaps"])

    return common.in_python(docs, find, f"key long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, words long, terms binary, gaps binary")


def _unpacked(batch: pa.RecordBatch, most: int = 100_000):
    """Yield (rows, first, terms, places) of runs of rows with about ``most`` hits."""
    terms, offsets = text.string_buffers(batch.column("terms"))
    gaps, _ = text.string_buffers(batch.column("gaps"))
    offsets = offsets // 4
    terms, gaps = terms.view(np.int32), gaps.view(np.int32)
    at, n = 0, batch.num_rows
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1))
        first = offsets[at : to + 1] - offsets[at]
        own = slice(offsets[at], offsets[to])
        sums = np.concatenate([[0], np.cumsum(gaps[own], dtype=np.int64)])
        yield np.arange(at, to), first, terms[own], sums[1:] - np.repeat(sums[first[:-1]], np.diff(first))
        at = to


def _blocks(first: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Number of each hit's block; blocks of different documents are never neighbours."""
    own = places // HALF
    last = np.zeros(len(first) - 1, np.int64)
    some = np.flatnonzero(np.diff(first))
    last[some] = own[first[1:][some] - 1] + 3
    return own + np.repeat(np.concatenate([[0], np.cumsum(last)[:-1]]), np.diff(first))


def _frequencies(hits: DataFrame, terms: int) -> np.ndarray:
    def count(batches):
        df = np.zeros(terms, np.int64)
        for batch in batches:
            for _, first, term, places in _unpacked(batch):
                pair = _blocks(first, places) * terms + term
                df += np.bincount(pd.unique(pair) % terms, minlength=terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], names=["term", "df"])

    out = np.zeros(terms, np.int64)
    found = common.in_python(hits.select("terms", "gaps"), count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow().to_pandas()
    out[found.term] = found.df
    return out


def _matrix(bench: Benchmark, first, term, places, table: np.ndarray):
    """Blocks with weighted hits: (block numbers, sums of the hits' rows of ``table``, hits' block, term)."""
    block = _blocks(first, places)
    live = bench.idf[term] > 0
    block, term = block[live], term[live]
    if not len(block):
        return block, np.empty((0, table.shape[1]), np.float32), block, term
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    return block[starts], np.add.reduceat(table[term], starts, axis=0), np.repeat(np.arange(len(starts)), np.diff(starts, append=len(block))), term


def _svd(hits: DataFrame, shared, rank: int, terms: int) -> np.ndarray:
    """(terms, rank): right singular vectors of the TF-IDF matrix of blocks, by a randomised range finder."""
    spark = hits.sparkSession
    width = min(rank + OVERSAMPLING, terms)
    # every task sends a matrix, so there are as many tasks as run at once, twice that at most
    hits = hits.coalesce(2 * spark.sparkContext.defaultParallelism)
    names = [f"g{i}" for i in range(width)]

    def gather(start):
        def gathered(batches):
            bench: Benchmark = shared.value
            probe = start.value * bench.idf[:, None]
            total = np.zeros((terms, width), np.float64)
            for batch in batches:
                for _, first, term, places in _unpacked(batch):
                    _, sums, row, term = _matrix(bench, first, term, places, probe)
                    order = np.argsort(term, kind="stable")
                    term = term[order]
                    starts = np.flatnonzero(np.diff(term, prepend=-1))
                    for at in range(0, len(starts), 2_000):
                        some = starts[at : at + 2_000]
                        end = starts[at + 2_000] if at + 2_000 < len(starts) else len(term)
                        total[term[some]] += np.add.reduceat(sums[row[order[some[0] : end]]], some - some[0], axis=0)
            total *= bench.idf[:, None]
            some = np.flatnonzero(np.abs(total).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(np.ascontiguousarray(total[some, i])) for i in range(width))], names=["term", *names])

        schema = "term int, " + ", ".join(f"{n} double" for n in names)
        found = common.in_python(hits.select("terms", "gaps"), gathered, schema).groupBy("term").agg(*(F.sum(n).alias(n) for n in names)).toArrow().to_pandas()
        out = np.zeros((terms, width))
        out[found.term] = found[names].to_numpy()
        return out

    start = np.random.default_rng(5).standard_normal((terms, width)).astype(np.float32)
    basis, _ = np.linalg.qr(gather(spark.sparkContext.broadcast(start)))
    # A^T A basis gives the small Gram matrix and, by it, singular vectors in order
    image = gather(spark.sparkContext.broadcast(basis.astype(np.float32)))
    values, turn = np.linalg.eigh(basis.T @ image)
    return (basis @ turn[:, np.argsort(-values, kind="stable")[:rank]]).astype(np.float32)


def _matches(hits: DataFrame, shared, cosine: float, share: float, item_type: str) -> DataFrame:
    def match(batches):
        bench: Benchmark = shared.value
        for batch in batches:
            best: dict[tuple[int, int], tuple] = {}
            for rows, first, term, places in _unpacked(batch):
                # documents without a term have no block
                some = np.flatnonzero(np.diff(first))
                rows, first = rows[some], np.append(first[some], first[-1])
                if not len(some):
                    continue
                number = _blocks(first, places)
                bases = (number - places // HALF)[first[:-1]]
                found_at = number[bench.is_answer[term]]
                many = np.searchsorted(found_at, found_at + bench.around, "right") - np.searchsorted(found_at, found_at - bench.around)
                block = np.unique(found_at[many >= bench.needed])
                if not len(block):
                    continue
                # windows: each such block with the one before and the one after it
                owner = bases[np.searchsorted(bases, block, "right") - 1]
                start = np.unique(np.concatenate([block, np.maximum(block - 1, owner)]))
                wanted = np.unique(np.concatenate([start, start + 1]))
                near_by = wanted[np.minimum(np.searchsorted(wanted, number), len(wanted) - 1)] == number
                live = near_by & (bench.idf[term] > 0)
                own_block = number[live]
                starts = np.flatnonzero(np.diff(own_block, prepend=-1))
                blocks, sums = own_block[starts], np.add.reduceat(bench.embedded[term[live]], starts, axis=0)

                def part(wanted, blocks=blocks, sums=sums):
                    at = np.minimum(np.searchsorted(blocks, wanted), len(blocks) - 1)
                    return sums[at] * (blocks[at] == wanted)[:, None]

                windows = part(start) + part(start + 1)
                windows /= np.maximum(np.linalg.norm(windows, axis=1, keepdims=True), 1e-9)
                for at in range(0, len(windows), 20_000):
                    near = windows[at : at + 20_000] @ bench.pieces.T
                    for i, piece in zip(*np.nonzero(near >= cosine), strict=True):
                        block_at, item = start[at + i], int(bench.owners[piece])
                        doc = int(np.searchsorted(bases, block_at, "right")) - 1
                        words = bench.items[item]
                        reach = max(len(words), HALF)
                        place = int(block_at - bases[doc]) * HALF
                        own = places[first[doc] : first[doc + 1]]
                        lo, hi = first[doc] + np.searchsorted(own, (place - reach, place + 2 * HALF + reach))
                        around = term[lo:hi].tolist()
                        answer = len(bench.answers[item].intersection(around)) / len(bench.answers[item])
                        if answer < ANSWER_SHARE:
                            continue
                        n = subsequence(bench.masks[item], len(words), around)
                        needed = share if len(words) >= SHORT else 1.0
                        if n < needed * len(words):
                            continue
                        found = (n / len(words), -place, answer, float(near[i, piece]))
                        slot = (int(rows[doc]), item)
                        if slot not in best or found[:2] > best[slot][:2]:
                            best[slot] = found
            if best:
                slots = sorted(best)
                at = pa.array([s[0] for s in slots])
                found = [best[s] for s in slots]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(at), batch.column("doc_id").take(at), pa.array([bench.ids[s[1]] for s in slots], types[item_type]), pa.array([-f[1] for f in found], pa.int64()), pa.array([f[3] for f in found]), pa.array([f[0] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64())],
                    names=["key", "doc_id", "item_id", "word", "cosine", "share", "answer_share"],
                )

    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return common.in_python(hits, match, f"key long, doc_id {hits.schema['doc_id'].dataType.simpleString()}, item_id {item_type}, word long, cosine double, share double, answer_share double")


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, share: float = SHARE, rank: int = RANK, items: int = ITEMS) -> DataFrame:
    """(key, doc_id, item_id, word, cosine, share, answer_share) for each document that holds an item."""
    spark = docs.sparkSession
    source = docs.select(common.row_key("doc_id", "text").alias("key"), "doc_id", "text")
    wanted = benchmark.select("item_id", "text").distinct()
    rounds = max(1, -(-wanted.count() // items))
    found: DataFrame | None = None
    for k in range(rounds):
        part = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == k) if rounds > 1 else wanted
        frame = part.toArrow().to_pandas()
        bench = Benchmark(frame)
        some = [i for i, item in enumerate(bench.items) if len(item)]
        bench = Benchmark(frame.iloc[some])
        if not len(bench.terms):
            empty = spark.createDataFrame([], f"key long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, word long, cosine double, share double, answer_share double")
            found = empty if found is None else found
            continue
        hits = common.written(_hits(source, spark.sparkContext.broadcast(bench)), "terms")
        terms = len(bench.terms)
        blocks = hits.agg(F.sum(F.ceil(F.col("words") / HALF))).first()[0] or 0
        df = _frequencies(hits, terms)
        bench.weigh(df, int(blocks))
        bench.project(_svd(hits, spark.sparkContext.broadcast(bench), rank, terms))
        matches = _matches(hits, spark.sparkContext.broadcast(bench), cosine, share, benchmark.schema["item_id"].dataType.simpleString())
        # the best window of each document and item; of texts with one item_id too
        rank_of = F.struct("share", (-F.col("word")).alias("early"), "cosine", "answer_share")
        best = matches.groupBy("key", "doc_id", "item_id").agg(F.max(rank_of).alias("best"))
        matches = best.select("key", "doc_id", "item_id", (-F.col("best.early")).alias("word"), "best.cosine", "best.share", "best.answer_share")
        found = matches if found is None else found.unionByName(matches)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that hold no item of the benchmark, with all their columns."""
    bad = common.written(contaminated(docs, benchmark, **options).select("key", "doc_id").distinct(), "leaks")
    return common.without(docs, bad, "doc_id", "text")
