"""SimHash near duplicates (operator 2): 256-bit fingerprints searched by the May-Ozerov recursion.

A document's fingerprint sums the hashed bits of its different pairs of neighbouring words (the first word
has a pair with the document's start). No pair is left out or weighed by how many documents have it, so a
fingerprint depends on its text alone and what a large group of copies shares counts in full. Two documents
are near duplicates if their fingerprints differ in at most ``RADIUS`` bits; groups are the connected components.

Search: the bits are dealt to disjoint random strips, one for each level. At a level, each of many random
centres keeps the fingerprints whose weight against it on that strip is small; close fingerprints are often
kept together, others seldom. The lists are filtered again at the next level until they are expected to be
small and are then compared all with all. A list that a large group of copies makes longer than ``LONG`` is
split: its parts share ``LEADERS`` rows, which link what the parts hold of the group; what isn't linked with the
list's largest group is then compared with the whole list, part by part. The number of centres of the first level is what makes the
recall of a pair at the full radius ``RECALL``; nearer pairs have more. Depth depends on the number of
fingerprints only, so no list is cut off however large a group of copies makes it.

Defined results
    * null and empty texts, and texts without a word, have no fingerprint and form no group
    * rows that are equal in doc_id and text are one row of the result, their number in ``rows``
    * equal fingerprints are found exactly; a group keeps its least doc_id (null last), ties by row key
    * an empty table gives an empty result; columns of other names, whatever they are, aren't read by
      ``near_duplicates`` and pass through ``near_duplicate_filter``; very long texts count whole
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import common, graph, text

BITS = 256
RADIUS = 52
RECALL = 0.92
#: Lists of about this length are compared all with all, and lists of about ``SHUFFLED`` are what is shuffled.
LIST, SHUFFLED = 1_024, 20_000
#: Longer lists (large groups of copies) are linked through leaders first, with the same components.
EXACT = 4_096
CENTRES = 80
#: Rows of a list that one task takes, and rows that all parts of a longer one share.
LONG, LEADERS = 80_000, 512

_LANES = np.zeros(256, np.uint64)
for _b in range(8):
    _LANES |= ((np.arange(256, dtype=np.uint64) >> np.uint64(_b)) & np.uint64(1)) << np.uint64(8 * _b)
_WORDS = ["f0", "f1", "f2", "f3"]


def fingerprints_of(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(documents, 4) words of 64 bits; ``first`` bounds each document's features; none give zeros."""
    sizes = np.diff(first)
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sizes), 4), np.uint64)
    if not len(full):
        return out
    # sums of 255 features at most fit in a byte lane
    pieces = -(-sizes[full] // 255)
    piece_first = np.concatenate([[0], np.cumsum(pieces)])
    starts = np.repeat(first[:-1][full] - 255 * piece_first[:-1], pieces) + 255 * np.arange(piece_first[-1])
    for word in range(4):
        lanes = text.mix(hashes + np.uint64(word * 0xA24BAED4963EE407 % 2**64)).view(np.uint8).reshape(-1, 8)
        bits = np.zeros(len(full), np.uint64)
        for byte in range(8):
            sums = np.add.reduceat(_LANES[lanes[:, byte]], starts).view(np.uint8).reshape(-1, 8)
            ones = np.add.reduceat(sums.astype(np.int64), piece_first[:-1], axis=0)
            set_ = (2 * ones > sizes[full][:, None]).astype(np.uint64)
            bits |= (set_ << np.arange(8, dtype=np.uint64)).sum(1) << np.uint64(8 * byte)
        out[full, word] = bits
    return out


def features(w: text.Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each document's different pairs of neighbouring words; ``first`` bounds the documents."""
    before = np.roll(w.hash, 1)
    before[w.first[:-1][np.diff(w.first) > 0]] = 0
    pair = text.mix(before * np.uint64(3) + text.mix(w.hash))
    keep = ~pd.Series(text.mix(pair + np.uint64(0x9E3779B97F4A7C15) * w.doc.astype(np.uint64))).duplicated().to_numpy()
    return pair[keep], np.concatenate([[0], np.cumsum(keep)])[w.first]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(key, doc_id, f0..f3): one row for each row of ``docs`` that has a word."""
    common.prepare(docs.sparkSession)
    source = docs.select(common.row_key("doc_id", "text").alias("key"), "doc_id", "text")

    def build(batches):
        for batch in batches:
            prints, has = np.zeros((batch.num_rows, 4), np.uint64), np.zeros(batch.num_rows, np.bool_)
            for chunk in text.chunks(batch.column("text")):
                w = text.words(chunk)
                prints[chunk.rows] = fingerprints_of(*features(w))
                has[chunk.rows] = np.diff(w.first) > 0
            rows = pa.array(np.flatnonzero(has))
            signed = prints[has].view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(rows), batch.column("doc_id").take(rows), *(pa.array(np.ascontiguousarray(signed[:, k])) for k in range(4))], names=["key", "doc_id", *_WORDS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.in_python(source, build, f"key long, doc_id {kind}, f0 long, f1 long, f2 long, f3 long")


def _signs(prints: np.ndarray) -> np.ndarray:
    """(n, 256) of -1 and 1."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1), axis=1)
    return bits.astype(np.float32) * 2 - 1


class Plan:
    """Strips, centres and depth of the recursion for ``n`` fingerprints."""

    def __init__(self, n: int, radius: int = RADIUS, recall: float = RECALL, size: int = LIST, shuffled: int = SHUFFLED) -> None:
        self.radius = radius
        strips = 4
        while True:
            strip = BITS // strips
            weights = np.array([math.comb(strip, a) for a in range(strip + 1)], np.float64) / 2.0**strip
            self.weight = int(np.flatnonzero(np.cumsum(weights) <= 0.06)[-1])
            p = float(weights[: self.weight + 1].sum())
            self.levels = max(0, math.ceil(math.log(max(n, 1) / size) / math.log(1 / p)))
            self.before = max(0, min(self.levels, math.ceil(math.log(max(n, 1) / shuffled) / math.log(1 / p))))
            if self.levels <= strips or strip <= 16:
                break
            strips *= 2
        self.levels = min(self.levels, strips)
        self.before = min(self.before, self.levels)
        if self.levels:
            self.before = max(self.before, 1)
        order = np.random.default_rng(77).permutation(BITS)
        self.strips = [np.sort(order[k * strip : (k + 1) * strip]) for k in range(strips)]
        self.joint = _joint(strip, self.weight, radius / BITS)
        reach = 1.0
        for _ in range(self.levels - 1):
            reach = 1 - (1 - self.joint * reach) ** CENTRES
        self.centres = [math.ceil(math.log(1 - recall) / math.log(1 - self.joint * reach))] + [CENTRES] * (self.levels - 1) if self.levels else []

    def kept(self, signs: np.ndarray, level: int, path: tuple[int, ...]) -> np.ndarray:
        """(n, centres): which rows each centre of a node keeps."""
        strip = self.strips[level]
        rng = np.random.default_rng([11, level, *path])
        centres = rng.integers(0, 2, (self.centres[level], len(strip))).astype(np.float32) * 2 - 1
        return signs[:, strip] @ centres.T >= len(strip) - 2 * self.weight

    def lists(self, signs: np.ndarray, rows: np.ndarray, level: int, to: int, path: tuple[int, ...]):
        """Yield (path, rows) of each list of two rows or more (of any, before the shuffle) at level ``to``."""
        if level == to:
            yield path, rows
            return
        kept = self.kept(signs[rows], level, path)
        for c in range(kept.shape[1]):
            some = rows[kept[:, c]]
            if len(some) > (to == self.levels):
                yield from self.lists(signs, some, level + 1, to, (*path, c))


@lru_cache
def _joint(strip: int, weight: int, share: float) -> float:
    """Chance that a centre keeps both of two strips that differ in each bit with chance ``share``."""

    def binomial(n: int, p: float) -> np.ndarray:
        return np.array([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])

    total = 0.0
    for a in range(weight + 1):
        other = np.convolve(binomial(a, 1 - share), binomial(strip - a, share))
        total += math.comb(strip, a) / 2.0**strip * other[: weight + 1].sum()
    return total


def led(signs: np.ndarray, radius: int, block: int = 1_024) -> tuple[np.ndarray, np.ndarray]:
    """Edges under Hamming distance ``radius`` that give the same components as a comparison of all with all.

    Each row is first linked with its leaders, rows that are near no earlier leader; that takes as many
    comparisons as rows times leaders, so a large group of copies of a text isn't compared all with all. Then
    the rows of two leaders' clusters that aren't linked yet are compared wherever the triangle inequality lets
    them be near: leaders at most ``radius`` and the clusters' own radii apart.
    """
    n, least = len(signs), BITS - 2 * radius
    leaders = np.empty(0, np.int64)
    home, apart = np.zeros(n, np.int64), np.zeros(n, np.int64)
    rows, others = [], []
    for at in range(0, n, block):
        own = np.arange(at, min(at + block, n))
        alike = signs[own] @ signs[leaders].T
        near = alike >= least
        x, y = np.nonzero(near)
        rows.append(own[x])
        others.append(leaders[y])
        if len(leaders):
            home[own] = alike.argmax(1)
            apart[own] = (BITS - alike.max(1)) / 2
        free = own[~near.any(1)]
        while len(free):
            alike = signs[free] @ signs[free[0]]
            close = alike >= least
            rows.append(free[close][1:])
            others.append(np.full(close.sum() - 1, free[0]))
            home[free[close]], apart[free[close]] = len(leaders), (BITS - alike[close]) / 2
            leaders = np.append(leaders, free[0])
            free = free[~close]
    reach = np.zeros(len(leaders), np.int64)
    np.maximum.at(reach, home, apart)
    order = np.argsort(home, kind="stable")
    first = np.searchsorted(home[order], np.arange(len(leaders) + 1))
    # clusters that the links so far join
    group = list(range(len(leaders)))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    number = np.zeros(n, np.int64)
    number[leaders] = np.arange(len(leaders))
    linked = home[np.concatenate(rows)] * len(leaders) + number[np.concatenate(others)]
    for i, j in zip(*divmod(np.unique(linked), len(leaders)), strict=True):
        group[root(int(i))] = root(int(j))
    heads = signs[leaders]
    step = max(1, 4_000_000 // len(leaders))
    for at in range(0, len(leaders), step):
        gap = (BITS - heads[at : at + step] @ heads.T) / 2
        able = gap <= radius + reach[at : at + step, None] + reach
        roots = np.array([root(i) for i in range(len(leaders))])
        able &= roots[at : at + step, None] < roots
        for i, j in zip(*np.nonzero(able), strict=True):
            i = int(i) + at
            if root(i) == root(int(j)):
                continue
            one, two = order[first[i] : first[i + 1]], order[first[j] : first[j + 1]]
            one = one[signs[one] @ heads[j] >= least - 2 * reach[j]]
            two = two[signs[two] @ heads[i] >= least - 2 * reach[i]]
            for k in range(0, len(one), size := max(1, 4_000_000 // max(len(two), 1))):
                x, y = np.nonzero(signs[one[k : k + size]] @ signs[two].T >= least)
                if len(x):
                    rows.append(one[k + x[:1]])
                    others.append(two[y[:1]])
                    group[root(i)] = root(int(j))
                    break
    return np.concatenate(rows), np.concatenate(others)


def forest(signs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, least row of its component) under Hamming distance ``radius``, by exact comparison."""
    n, least = len(signs), BITS - 2 * radius
    if n > EXACT:
        return led(signs, radius)
    label = np.arange(n)
    step = max(1, 4_000_000 // max(n, 1))
    while True:
        new = label.copy()
        for at in range(0, n, step):
            near = signs[at : at + step] @ signs.T >= least
            rows, others = np.nonzero(near)
            np.minimum.at(new, rows + at, label[others])
        new = new[new]
        if (new == label).all():
            break
        label = new
    rows = np.flatnonzero(label != np.arange(n))
    return rows, label[rows]


def _split(lists: DataFrame, long: DataFrame, link, radius: int, part: int) -> DataFrame:
    """Edges (a, b) of the lists in ``long`` (list, n), in tasks of about ``part`` rows.

    Every pair that one task would find is linked: within a part; through the leaders, which all parts have; or, if a
    row isn't in the list's main group by then, by a comparison with all rows of the list.
    """
    rows = lists.join(common.small(long), "list")
    rows = common.written(rows.select("list", F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("n") / part)).alias("part"), "node", *_WORDS), "long")
    order = F.row_number().over(Window.partitionBy("list").orderBy(F.xxhash64("node", F.lit(2)), "node"))
    leaders = rows.withColumn("rank", order).filter(F.col("rank") <= LEADERS).select("list", "node", *_WORDS)
    parts = rows.select("list", "part").distinct()
    both = common.written(rows.unionByName(leaders.join(common.small(parts), "list").select(*rows.columns)).dropDuplicates(["list", "part", "node"]), "parts")
    edges = common.written(both.groupBy("list", "part").applyInArrow(link, "a long, b long"), "edges")
    roots = graph.components(edges)
    rows = common.written(rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    counts = rows.groupBy("list", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("list").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"))
    main = common.written(main.select("list", F.col("top.root").alias("main"), (F.col("all") - F.col("top.n")).alias("free")).filter("free > 0"), "main")
    blocks = main.select("list", F.explode(F.sequence(F.lit(0), F.ceil(F.col("free") / part).cast("int") - 1)).alias("block"))
    free = rows.join(common.small(main), "list").filter("root <> main").withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.col("free") / part)).cast("int"))
    free = free.select("list", "block", "node", "root", *_WORDS).join(common.small(parts), "list")
    again = rows.select(*(F.col(c).alias(c) for c in rows.columns))
    every = again.join(common.small(blocks), "list").select("list", "part", "block", "node", "root", *_WORDS)

    def compare(one, two):
        first, second = (np.empty(0, np.int64), np.empty(0, np.int64))
        if one.num_rows and two.num_rows:
            x, y = (_signs(np.stack([t.column(c).to_numpy() for c in _WORDS], 1)) for t in (one, two))
            out = []
            roots_x, roots_y = one.column("root").to_numpy(), two.column("root").to_numpy()
            for at in range(0, len(x), step := max(1, 4_000_000 // len(y))):
                near = (x[at : at + step] @ y.T >= BITS - 2 * radius) & (roots_x[at : at + step, None] != roots_y)
                i, j = np.nonzero(near)
                out.append(np.unique(np.stack([one.column("root").to_numpy()[at + i], roots_y[j]], 1), axis=0))
            first, second = np.unique(np.concatenate(out), axis=0).T
        common.release()
        return pa.table({"a": pa.array(np.ascontiguousarray(first)), "b": pa.array(np.ascontiguousarray(second))})

    # roots are nodes too, so links between them link their groups
    key = ["list", "part", "block"]
    return edges.union(free.groupBy(*key).cogroup(every.groupBy(*key)).applyInArrow(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL, long: int = LONG, part: int = SHUFFLED) -> DataFrame:
    """(key, doc_id, rows, group_id, group_size, keep) for each different row of ``docs`` that has a word.

    ``group_id`` is the least doc_id of the group, ``group_size`` counts rows, ``keep`` marks the one that stays.
    """
    prints = fingerprints(docs).withColumn("node", F.xxhash64(*_WORDS))
    prints = common.written(prints.groupBy("key", "doc_id", "node", *_WORDS).agg(F.count("*").alias("rows")), "simhash")
    distinct = prints.groupBy("node").agg(*(F.first(c).alias(c) for c in _WORDS))
    plan = Plan(distinct.count(), radius, recall)

    def spread(batches):
        for batch in batches:
            ids = batch.column("node").to_numpy()
            signs = _signs(np.stack([batch.column(c).to_numpy() for c in _WORDS], 1))
            lists, rows = [], []
            for path, some in plan.lists(signs, np.arange(len(ids)), 0, plan.before, ()):
                mark = 0
                for c in path:
                    mark = mark * 1_000 + c + 1
                lists.append(np.full(len(some), mark))
                rows.append(some)
            if rows:
                take = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), pa.array(ids[take]), *(batch.column(c).take(pa.array(take)) for c in _WORDS)], names=["list", "node", *_WORDS])

    def link(found):
        ids = found.column("node").to_numpy()
        signs = _signs(np.stack([found.column(c).to_numpy() for c in _WORDS], 1))
        mark, path = found.column("list")[0].as_py(), []
        while mark:
            path.append(mark % 1_000 - 1)
            mark //= 1_000
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for _, rows in plan.lists(signs, np.arange(len(ids)), plan.before, plan.levels, tuple(path[::-1])):
            x, y = forest(signs[rows], radius)
            a.append(ids[rows[x]])
            b.append(ids[rows[y]])
        both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
        common.release()
        return pa.table({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})

    lists = common.written(common.in_python(distinct, spread, "list long, node long, f0 long, f1 long, f2 long, f3 long"), "lists")
    longer = common.written(lists.groupBy("list").agg(F.count("*").alias("n")).filter(F.col("n") > long), "longer")
    if longer.isEmpty():
        edges = lists.groupBy("list").applyInArrow(link, "a long, b long")
    else:
        rest = lists.join(common.small(longer), "list", "left_anti")
        edges = rest.groupBy("list").applyInArrow(link, "a long, b long").union(_split(lists, longer, link, radius, part))
    roots = graph.components(edges)
    grouped = prints.join(roots, "node", "left").withColumn("group", F.coalesce("root", "node"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    groups = grouped.groupBy("group").agg(F.min(order).alias("first"), F.sum("rows").alias("group_size"))
    return grouped.join(groups, "group").select("key", "doc_id", "rows", F.col("first.doc_id").alias("group_id"), "group_size", (F.col("key") == F.col("first.key")).alias("keep"))


def near_duplicate_filter(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group, and one of each set of equal rows; rows without a word stay."""
    found = common.written(near_duplicates(docs, **options), "near")
    kept = common.without(docs, found.filter("not keep"), "doc_id", "text")
    again = found.filter("keep and rows > 1")
    if again.isEmpty():
        return kept
    once = common.without(kept, again, "doc_id", "text")
    key, mark = common.fresh(docs, "_key", "_mark")
    marks = common.small(again.select(F.col("key").alias(mark)).distinct())
    repeated = kept.withColumn(key, common.row_key("doc_id", "text")).join(marks, F.col(key) == F.col(mark), "left_semi")
    return once.unionByName(repeated.dropDuplicates([key, "doc_id"]).drop(key))
