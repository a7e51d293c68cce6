"""Document fingerprints by randomised edit embedding (operator 4).

A walk over a document's bytes writes the byte under its pointer at every step and then moves on or stays, by
a random bit of the step and the byte that all documents share. Texts of small edit distance fall into step
again after each edit, so their embeddings agree over long stretches (small Hamming distance). A band samples
``SAMPLES`` places of the embedding within ``WIDTH`` steps. The bands lie at ``BANDS`` steps that all texts of a
length class share; a text is also in the class below where a near one may be, so near texts have a class in
common. A key is two bands that are ``GAP`` bands apart, so texts that share but one passage seldom have a key
in common. Every pair of texts with a common key is a candidate; groups are the components of the candidates
that are near: an edit distance of at most ``NEAR`` of the longer text's bytes.

Candidates are verified in two rounds. First each text is compared with the ``PARTNERS`` that are the hub of
most of its keys, the text that has most candidates. Then all candidates that are still in different groups are, whatever their number:
texts that are compared with the same ones are cut into blocks, and for two blocks each text is sent once, not once a
pair. Pairs are rejected by a lower bound first: an edit changes ``GRAM`` of a text's GRAM-byte sequences
at most, so texts whose counts of them (over ``CELLS`` hash cells) differ more aren't near.

Defined results
    * one row for each row of ``docs``; repeated rows share a group; exact copies are always found
    * null and empty texts have a null fingerprint and group (an empty text is near no other)
    * ``group_id`` is the least doc_id of the group (null last), its own for a document without partners; ties
      don't arise, as equal doc_ids are the same id
    * texts too short for an edit within ``NEAR`` are near their exact copies only
    * very long texts are walked and compared whole; an empty table gives an empty result
    * columns of other names, whatever they are, aren't read
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import common, graph, text

NEAR = 0.05
BANDS, GAP = 32, 4
#: Steps of the walk that the samples of a band are taken from, and their number.
WIDTH, SAMPLES = 24, 12
#: Ratio of the lengths of neighbouring classes.
CLASS = 1.22
PARTNERS = 2
GRAM, CELLS = 4, 512
#: Limits up to which the bands of ``TOGETHER`` pairs are worked on at once; wider ones are fast one by one.
WIDE, TOGETHER = 400, 4096
#: Bytes and texts of a block.
BLOCK, MEMBERS = 256 << 10, 128
PERIOD = 4096
STRETCH = 12 << 20
_END = 0xFF  # no byte of UTF-8


def _steps() -> np.ndarray:
    moves = np.random.default_rng(31).integers(0, 2, (PERIOD, 256)).astype(np.int64)
    moves[:, _END] = 0
    return moves


def classes(sizes: np.ndarray, share: float = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """(rows, classes): the length class of each text that an edit may be near to, and the one below if need be."""
    rows = np.flatnonzero(np.floor(share * sizes) > 0)
    own = np.floor(np.log(sizes[rows]) / math.log(CLASS)).astype(np.int64)
    low = np.floor(np.log(sizes[rows] * (1 - share)) / math.log(CLASS) - 1e-9).astype(np.int64)
    also = low < own
    return np.concatenate([rows, rows[also]]), np.concatenate([own, low[also]])


def _places(level: int, bands: int) -> tuple[np.ndarray, int]:
    """(bands, samples): the steps that the bands of a class sample, and the steps that the class walks."""
    steps = max(2 * int(CLASS**level) - 1, 2)
    width = min(WIDTH, steps // 2)
    offsets = np.sort(np.concatenate([[0], np.random.default_rng(43).choice(np.arange(1, WIDTH), SAMPLES - 1, replace=False)]))
    starts = np.arange(bands) * (steps - width) // max(bands - 1, 1)
    return starts[:, None] + offsets[None, :] * width // WIDTH, steps


def walk(chunk: text.Chunk, share: float = NEAR, bands: int = BANDS, gap: int = GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, keys, whole): the keys (documents, bands - gap) of each class of each document, and a hash of
    all samples."""
    sizes = np.diff(chunk.offsets)
    rows, level = classes(sizes, share)
    if not len(rows):
        return rows, np.empty((0, bands - gap), np.uint64), np.empty(0, np.uint64)
    order = np.argsort(-level, kind="stable")
    rows, level = rows[order], level[order]
    firsts = np.flatnonzero(np.diff(level, prepend=level[0] + 1))
    # what is written down at each step: (column of the samples, range of documents)
    wanted: dict[int, list[tuple[int, int, int]]] = {}
    ends = []
    for lo, hi in zip(firsts.tolist(), [*firsts[1:].tolist(), len(rows)], strict=True):
        places, steps = _places(int(level[lo]), bands)
        ends.append((hi, steps))
        for column, step in enumerate(places.ravel().tolist()):
            wanted.setdefault(step, []).append((column, lo, hi))
    seen_at = np.zeros((bands * SAMPLES, len(rows)), np.uint8)
    # every document is followed by an end mark, where its pointer stays
    buffer = np.full(len(chunk.data) + chunk.n, _END, np.uint8)
    buffer[np.arange(len(chunk.data)) + np.repeat(np.arange(chunk.n), sizes)] = chunk.data
    pointer = (chunk.offsets[:-1] + np.arange(chunk.n))[rows]
    moves = _steps()
    for step in range(ends[0][1]):
        while ends[-1][1] <= step:
            ends.pop()
        active = ends[-1][0]
        seen = buffer.take(pointer[:active])
        for column, lo, hi in wanted.get(step, ()):
            seen_at[column, lo:hi] = seen[lo:hi]
        pointer[:active] += moves[step % PERIOD].take(seen)
    hashes = np.zeros((bands, len(rows)), np.uint64)
    for k in range(SAMPLES):
        hashes = text.mix(hashes + seen_at[k::SAMPLES].astype(np.uint64) + np.uint64(1))
    salt = np.arange(bands, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + level.astype(np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
    hashes = text.mix(hashes + salt)
    keys = text.mix(hashes[: bands - gap] * np.uint64(3) + text.mix(hashes[gap:])).T
    return rows, keys, np.bitwise_xor.reduce(hashes, axis=0)


def keys_of(docs: DataFrame, share: float = NEAR, bands: int = BANDS, gap: int = GAP) -> DataFrame:
    """(band, node, size, whole): each text's keys as ``band`` with its bytes, and a row with its fingerprint as
    ``band`` and whole set."""

    def run(batches):
        for batch in text.gathered(batches, "text", STRETCH):
            nodes = batch.column("node").to_numpy()
            for chunk in text.chunks(batch.column("text"), 2 * STRETCH):
                document, keys, every = walk(chunk, share, bands, gap)
                own, size = nodes[chunk.rows], np.diff(chunk.offsets)
                # without keys (short texts) the text's own hash
                whole = own.view(np.uint64).copy()
                np.bitwise_xor.at(whole, document, every)
                for at in range(0, len(document), 10_000):
                    to = slice(at, at + 10_000)
                    row = np.repeat(document[to], keys.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[to].ravel().view(np.int64)), pa.array(own[row]), pa.array(size[row]), pa.array(np.zeros(len(row), np.bool_))], names=["band", "node", "size", "whole"])
                yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array(own), pa.array(size), pa.array(np.ones(chunk.n, np.bool_))], names=["band", "node", "size", "whole"])

    return common.in_python(docs.select("node", "text"), run, "band long, node long, size long, whole boolean")


def agreeing(keys: DataFrame) -> DataFrame:
    """(band, node, size, hub): the rows of keys that two texts have.

    ``hub`` is the text of the key with most candidates by all its keys, ties by the node. Edited copies have lost
    the keys around their edits, so the text that they were copied from has most.
    """
    groups = keys.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most")
    groups = common.written(groups.select(F.col("band").alias("_band"), "n"), "groups")
    rows = common.written(keys.join(common.small(groups), F.col("band") == F.col("_band")).select("band", "node", "size", "n"), "shared")
    weights = common.written(rows.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    hubs = rows.join(common.small(weights), "node").groupBy("band").agg(F.max(F.struct("weight", "node")).alias("hub"))
    return rows.join(hubs.select("band", "hub.node").toDF("band", "hub"), "band").select("band", "node", "size", "hub")


def able(a: str, b: str, share: float):
    """Whether texts of the sizes ``a`` and ``b`` may be near."""
    return F.abs(F.col(a) - F.col(b)) <= F.floor(F.greatest(a, b) * F.lit(share))


def stars(rows: DataFrame, share: float = NEAR, partners: int = PARTNERS) -> DataFrame:
    """(a, b): each text with those that are the hub of most of its keys; ties by the least."""
    heads = rows.filter("node = hub").select(F.col("node").alias("b"), F.col("size").alias("n")).distinct()
    votes = rows.filter("node <> hub").groupBy(F.col("node").alias("a"), F.col("hub").alias("b")).agg(F.count("*").alias("votes"), F.min("size").alias("m"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("votes"), "b"))
    return votes.join(common.small(heads), "b").filter(able("m", "n", share)).withColumn("rank", rank).filter(F.col("rank") <= partners).select("a", "b")


def candidates(rows: DataFrame, roots: DataFrame, share: float = NEAR) -> DataFrame:
    """(a, b): all pairs with a common key, of different roots, that differ little enough in length.

    Of a key that a large group has, only the others are paired with all that have it.
    """
    known = common.small(roots.toDF("_node", "_root"))
    own = rows.join(known, F.col("node") == F.col("_node"), "left").select("band", "node", "size", "hub", F.coalesce("_root", "node").alias("root"))
    heads = own.filter("node = hub").select(F.col("band").alias("_band"), F.col("root").alias("main"))
    mixed = own.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select(F.col("band").alias("_mixed"))
    own = common.written(own.join(common.small(mixed), F.col("band") == F.col("_mixed"), "left_semi").join(common.small(heads), F.col("band") == F.col("_band")).select("band", "node", "size", "root", "main"), "mixed")
    one = own.filter("root <> main").select("band", F.col("node").alias("a"), F.col("size").alias("m"), F.col("root").alias("p"))
    two = own.select("band", F.col("node").alias("b"), F.col("size").alias("n"), F.col("root").alias("q"))
    return one.join(two, "band").filter((F.col("p") != F.col("q")) & able("m", "n", share)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def sketch_of(raw: np.ndarray) -> np.ndarray:
    """Counts, up to 255, of a text's GRAM-byte sequences in ``CELLS`` hash cells."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(CELLS, np.uint8)
    code = np.zeros(n, np.uint32)
    for k in range(GRAM):
        code = (code << np.uint32(8)) | raw[k : n + k]
    cell = (code * np.uint32(2654435761)) >> np.uint32(32 - CELLS.bit_length() + 1)
    return np.minimum(np.bincount(cell, minlength=CELLS), 255).astype(np.uint8)


def sketches(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, size, sketch) of the texts of ``nodes``."""
    own = docs.join(common.small(nodes.toDF("_node")), F.col("node") == F.col("_node"), "left_semi").select("node", "text")

    def run(batches):
        for batch in batches:
            data, offsets = text.string_buffers(batch.column("text"))
            found = [sketch_of(data[offsets[i] : offsets[i + 1]]).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(np.diff(offsets)), pa.array(found, pa.binary())], names=["node", "size", "sketch"])

    return common.in_python(own, run, "node long, size long, sketch binary").groupBy("node").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"))


def possible(pairs: DataFrame, sketched: DataFrame, share: float = NEAR) -> DataFrame:
    """The pairs that the lower bound of their sketches lets be near."""

    def run(batches):
        for batch in batches:
            x, y = (text.string_buffers(batch.column(c))[0].reshape(-1, CELLS) for c in ("x", "y"))
            limit = np.floor(share * np.maximum(batch.column("m").to_numpy(), batch.column("n").to_numpy()))
            take = pa.array(np.flatnonzero(np.abs(x.astype(np.int16) - y).sum(1) <= 2 * GRAM * limit))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take)], names=["a", "b"])

    both = pairs.join(sketched.toDF("a", "m", "x"), "a").join(sketched.toDF("b", "n", "y"), "b")
    return common.in_python(both.select("a", "b", "m", "n", "x", "y"), run, "a long, b long")


def edit_distance(a: bytes, b: bytes) -> int:
    """Levenshtein distance by bit-parallel columns (Myers)."""
    if len(a) > len(b):
        a, b = b, a
    n = len(a)
    if not n:
        return len(b)
    masks: dict[int, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << n - 1
    plus, minus, score = full, 0, n
    for c in b:
        m = masks.get(c, 0)
        zero = (((m & plus) + plus) ^ plus) | m | minus
        up = minus | ~(zero | plus) & full
        down = plus & zero
        if up & top:
            score += 1
        if down & top:
            score -= 1
        up = up << 1 | 1
        down <<= 1
        plus = (down | ~(zero | up)) & full
        minus = up & zero & full
    return score


def _stripped(a: bytes, b: bytes) -> tuple[bytes, bytes]:
    """The longer and the shorter text without their common start and end."""
    if len(a) < len(b):
        a, b = b, a
    same = next((i for i in range(0, len(b), 64) if a[i : i + 64] != b[i : i + 64]), len(b))
    while same < len(b) and a[same] == b[same]:
        same += 1
    a, b = a[same:], b[same:]
    tail = next((i for i in range(0, len(b) - 63, 64) if a[len(a) - i - 64 : len(a) - i] != b[len(b) - i - 64 : len(b) - i]), len(b) // 64 * 64)
    while tail < len(b) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return a[: len(a) - tail], b[: len(b) - tail]


def _settled(a: bytes, b: bytes, limit: int) -> bool | None:
    """Whether the distance of stripped texts is at most ``limit``, where their lengths tell."""
    if len(a) - len(b) > limit or a and not limit:
        return False
    return True if len(a) <= limit else None


def _reach(longer: int, shorter: int, limit: int) -> tuple[int, int]:
    """Diagonals (above, below) the first that a path of at most ``limit`` edits touches: what it leaves to one side
    it must come back from."""
    return (limit - longer + shorter) // 2, (limit + longer - shorter) // 2


def within(a: bytes, b: bytes, limit: int) -> bool:
    """Whether the Levenshtein distance is at most ``limit``, by bit-parallel columns of a diagonal band (Hyyrö)."""
    a, b = _stripped(a, b)
    known = _settled(a, b, limit)
    if known is not None:
        return known
    above, below = _reach(len(a), len(b), limit)
    width = above + below + 1
    if len(a) <= width:
        return edit_distance(a, b) <= limit
    masks: dict[int, int] = {}
    codes = np.frombuffer(a, np.uint8)
    for c in set(b):
        masks[c] = int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little")
    # the band has the rows of a from above to below the diagonal
    full, diagonal = (1 << width) - 1, 1 << width - 1
    plus, minus, score = full & ~((1 << above) - 1), 0, below
    at, most = -above, limit + below + len(b) - len(a)
    turn, horizontal = len(a) - below, 1 << width >> 2
    for i, c in enumerate(b):
        m = masks[c]
        m = (m >> at if at >= 0 else m << -at) & full
        zero = ((((m & plus) + plus) ^ plus) | m | minus) & full
        up = (minus | ~(zero | plus)) & full
        down = zero & plus
        if i < turn:
            score += not zero & diagonal
            if score > most:
                return False
        else:
            score += bool(up & horizontal) - bool(down & horizontal)
            horizontal >>= 1
        plus = (down | ~((zero >> 1) | up)) & full
        minus = (zero >> 1) & up
        at += 1
    return score <= limit


def _banded(group: list[tuple[int, bytes, bytes]]) -> np.ndarray:
    """``within`` of many stripped texts (limit, a, b) at once; the first of each is longer than the band."""
    above, below = (max(x) for x in zip(*(_reach(len(a), len(b), limit) for limit, a, b in group), strict=True))
    width = above + below + 1
    words = -(-width // 64)
    n, m = (np.array([len(g[k]) for g in group]) for k in (1, 2))
    limits = np.array([g[0] for g in group])
    rows, columns = np.full((len(group), above + n.max() + 64 * words), _END, np.uint8), np.full((len(group), m.max()), _END, np.uint8)
    for k, (_, a, b) in enumerate(group):
        rows[k, above : above + len(a)] = np.frombuffer(a, np.uint8)
        columns[k, : len(b)] = np.frombuffer(b, np.uint8)
    full = np.full((words, 1), 2**64 - 1, np.uint64)
    full[-1] = (1 << width - 64 * (words - 1)) - 1
    first = np.array([((1 << width) - 1 & ~((1 << above) - 1)) >> 64 * w & 2**64 - 1 for w in range(words)], np.uint64)
    out = np.zeros(len(group), np.bool_)
    own, one = np.arange(len(group)), np.uint64(1)
    plus, minus = np.repeat(first[:, None], len(own), 1), np.zeros((words, len(own)), np.uint64)
    score, most, turn = np.full(len(own), below), limits + below + m - n, n - below
    top_word, top_bit = (width - 1) >> 6, np.uint64((width - 1) & 63)
    for i in range(int(m.max())):
        if i % 32 == 0:
            done = m <= i
            out[own[done]] = score[done] <= limits[done]
            stay = ~done & ((score <= most) | (i > turn))
            if not stay.any():
                return out
            if stay.mean() < 0.8:
                own, m, n, score, most, turn, limits = (x[stay] for x in (own, m, n, score, most, turn, limits))
                plus, minus, rows, columns = np.ascontiguousarray(plus[:, stay]), np.ascontiguousarray(minus[:, stay]), rows[stay], columns[stay]
        equal = np.packbits(rows[:, i : i + 64 * words] == columns[:, i : i + 1], axis=1, bitorder="little").view(np.uint64)
        equal = equal.T & full
        zero = equal & plus
        carry = np.zeros(zero.shape[1], np.uint64)
        for w in range(words):
            total = zero[w] + plus[w]
            over = total < plus[w]
            total += carry
            over |= total < carry
            zero[w] = total
            carry = over.astype(np.uint64)
        zero ^= plus
        zero |= equal
        zero |= minus
        zero &= full
        up = zero | plus
        np.invert(up, out=up)
        up |= minus
        up &= full
        down = zero & plus
        live = i < m
        early = live & (i < turn)
        score += early & ((zero[top_word] >> top_bit & one) == 0)
        late = np.flatnonzero(live & (i >= turn))
        if len(late):
            place = width - 2 - (i - turn[late])
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            score[late] += (up[word, late] >> bit & one).astype(np.int64) - (down[word, late] >> bit & one).astype(np.int64)
        shifted = zero >> one
        shifted[:-1] |= zero[1:] << np.uint64(63)
        plus = shifted | up
        np.invert(plus, out=plus)
        plus |= down
        plus &= full
        minus = shifted & up
    out[own] = score <= limits
    return out


def _counts_allow(a: bytes, b: bytes, limit: int) -> bool:
    """Whether the numbers of each byte let the distance be at most ``limit``."""
    extra = np.subtract(*(np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in (a, b)))
    return max(extra[extra > 0].sum(), -extra[extra < 0].sum()) <= limit


def near_all(one: list[bytes], two: list[bytes], share: float = NEAR) -> np.ndarray:
    """``near`` of each pair; the bands of many texts are worked on at once if they are narrow."""
    out, left = np.zeros(len(one), np.bool_), []
    for k, (a, b) in enumerate(zip(one, two, strict=True)):
        limit = int(share * max(len(a), len(b)))
        if abs(len(a) - len(b)) > limit or not _counts_allow(a, b, limit):
            continue
        if limit > WIDE:
            out[k] = near(a, b, share)
            continue
        a, b = _stripped(a, b)
        known = _settled(a, b, limit)
        if known is None:
            left.append((limit, len(b), a, b, k))
        else:
            out[k] = known
    left.sort(key=lambda x: x[:2])
    at = 0
    while at < len(left):
        # bands of much the same width
        to = bisect_right(left, left[at][0] * 5 // 4 + 4, at, min(at + TOGETHER, len(left)), key=lambda x: x[0])
        some = left[at:to]
        at, reach = to, some[-1][0]
        # no band is wider, as differences of lengths are within the limits
        for limit, _, a, b, k in some:
            if len(a) <= 2 * reach + 1:
                out[k] = edit_distance(a, b) <= limit
        some = [x for x in some if len(x[2]) > 2 * reach + 1]
        if some:
            out[[x[4] for x in some]] = _banded([(limit, a, b) for limit, _, a, b, _ in some])
    return out


def _rising(values: list[int]) -> list[int]:
    """Indices of a longest rising subsequence."""
    ends: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(ends, v)
        if k == len(ends):
            ends.append(v)
            at.append(i)
        else:
            ends[k], at[k] = v, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def near(a: bytes, b: bytes, share: float = NEAR) -> bool:
    """Whether the edit distance is at most ``share`` of the longer text.

    Words that each text has once, in the same order, cut both into pieces; the sum of the pieces' distances
    bounds the distance from above. Where that bound is above the limit the distance itself decides; only a
    lower bound, by the number of each byte, rejects without it.
    """
    limit = int(share * max(len(a), len(b)))
    if abs(len(a) - len(b)) > limit:
        return False
    if a == b:
        return True
    if not _counts_allow(a, b, limit):
        return False
    x, y = text.words_of(a), text.words_of(b)
    hx, ix, nx = np.unique(x.hash, return_index=True, return_counts=True)
    hy, iy, ny = np.unique(y.hash, return_index=True, return_counts=True)
    _, px, py = np.intersect1d(hx[nx == 1], hy[ny == 1], assume_unique=True, return_indices=True)
    wx, wy = ix[nx == 1][px], iy[ny == 1][py]
    order = np.argsort(wx)
    wx, wy = wx[order], wy[order]
    some = _rising(wy.tolist())
    bound, at, to = 0, 0, 0
    for i in [*some, None]:
        u, v = (len(a), len(b)) if i is None else (int(x.start[wx[i]]), int(y.start[wy[i]]))
        if u >= at and v >= to:
            one, two = a[at:u], b[to:v]
            if one != two:
                bound += edit_distance(one, two) if min(len(one), len(two)) < 2_000 else max(len(one), len(two))
                if bound > limit:
                    return within(a, b, limit)
            at, to = u, v
    return True


def units(pairs: DataFrame, sizes: DataFrame, block: int = BLOCK, members: int = MEMBERS) -> DataFrame:
    """(unit, a, b): each pair of ``pairs`` with the two blocks that its texts, of ``sizes`` (node, size), are in.

    Texts that have partners in common get a common label, the least text near by, and the texts of a label are cut
    into blocks. Labels decide only how often a text is sent.
    """
    both = common.written(pairs.union(pairs.select("b", "a")).toDF("v", "w"), "both")
    label = F.least(F.min("w"), F.col("v"))
    first = common.written(both.groupBy("v").agg(label.alias("first")), "labels")
    second = both.join(common.small(first.toDF("w", "label")), "w").groupBy("v").agg(F.min("label").alias("label"))
    nodes = common.written(second.join(sizes.toDF("v", "size"), "v"), "labels")
    cuts = nodes.groupBy("label").agg(F.greatest(F.ceil(F.sum("size") / F.lit(block)), F.ceil(F.count("*") / F.lit(members)), F.lit(1)).alias("cuts"))
    blocks = common.small(common.written(nodes.join(common.small(cuts), "label").select("v", F.xxhash64("label", F.expr("pmod(v, cuts)")).alias("block")), "blocks"))
    found = pairs.join(blocks.toDF("a", "p"), "a").join(blocks.toDF("b", "q"), "b")
    return found.select(F.xxhash64(F.least("p", "q"), F.greatest("p", "q")).alias("unit"), "a", "b")


def verified_in_blocks(pairs: DataFrame, docs: DataFrame, sizes: DataFrame, share: float = NEAR) -> DataFrame:
    """As ``verified``, for many pairs of few texts: for each unit of ``units`` a text is sent once, then its pairs.

    What is sent grows with the pairs divided by the texts of a block.
    """
    spark = pairs.sparkSession
    cut = common.written(units(pairs, sizes), "units")
    wanted = cut.select("unit", F.col("a").alias("node")).union(cut.select("unit", "b")).distinct()
    some = common.small(common.written(wanted.select(F.col("node").alias("_node")).distinct(), "wanted"))
    own = docs.join(some, F.col("node") == F.col("_node"), "left_semi").select("node", "text").dropDuplicates(["node"])
    sent = wanted.join(own.hint("merge"), "node").select("unit", F.lit(False).alias("pair"), F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = sent.union(cut.select("unit", F.lit(True), "a", "b", F.lit(None).cast("string")))

    def tested(held):
        a, b, x, y, allowed = zip(*held, strict=True)
        one, two = (np.frombuffer(b"".join(t), np.uint8).reshape(-1, CELLS).astype(np.int16) for t in ([u[1] for u in x], [u[1] for u in y]))
        limit = np.array(allowed)
        kept = np.flatnonzero(np.abs(one - two).sum(1) <= 2 * GRAM * limit)
        kept = kept[near_all([x[k][0] for k in kept], [y[k][0] for k in kept], share)]
        return pa.RecordBatch.from_arrays([pa.array([a[k] for k in kept], pa.int64()), pa.array([b[k] for k in kept], pa.int64())], names=["a", "b"])

    def check(batches):
        unit, texts, held, have = None, {}, [], 0
        for batch in batches:
            for at, pair, a, b, t in zip(*(batch.column(c).to_pylist() for c in ("unit", "pair", "a", "b", "text")), strict=True):
                if at != unit:
                    unit, texts = at, {}
                if not pair:
                    raw = t.encode()
                    texts[a] = raw, sketch_of(np.frombuffer(raw, np.uint8)).tobytes()
                    have += len(raw)
                    continue
                x, y = texts[a], texts[b]
                held.append((a, b, x, y, int(share * max(len(x[0]), len(y[0])))))
                if len(held) >= 2 * TOGETHER or have > STRETCH:
                    yield tested(held)
                    held, have = [], 0
        if held:
            yield tested(held)

    # the number of parts is given, as few bytes are much work here
    parts = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "unit").sortWithinPartitions("unit", "pair")
    return common.written(common.in_python(parts, check, "a long, b long"), "near")


def verified(pairs: DataFrame, docs: DataFrame, share: float = NEAR) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose texts, of ``docs`` (node, text), are near.

    Pairs are tried one by one, as an upper bound soon accepts those that are near.
    Texts are bucketed by node once; of the two joins only the pairs and the first texts are shuffled.
    """
    spark = pairs.sparkSession
    wanted = pairs.select("a").union(pairs.select("b")).distinct().toDF("_node")
    own = docs.join(common.small(common.written(wanted, "wanted")), F.col("node") == F.col("_node"), "left_semi").select("node", "text")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"corpusloom_texts_{uuid.uuid4().hex}", common.scratch(spark, "texts")
    # copies are combined before the shuffle
    own.dropDuplicates(["node"]).write.bucketBy(buckets, "node").sortBy("node").option("path", path).format("parquet").saveAsTable(name)
    texts = spark.table(name)

    def check(batches):
        for batch in batches:
            one, two = batch.column("x"), batch.column("y")
            x, y = ([t.encode() for t in c.to_pylist()] for c in (one, two))
            take = pa.array(np.flatnonzero([near(p, q, share) for p, q in zip(x, y, strict=True)]))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take)], names=["a", "b"])

    both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
    found = common.written(common.in_python(both.select("a", "b", "x", "y"), check, "a long, b long"), "near")
    spark.sql(f"drop table if exists {name}")
    common.drop_path(spark, path)
    return found


def fingerprints(docs: DataFrame, share: float = NEAR, bands: int = BANDS, gap: int = GAP) -> DataFrame:
    """(doc_id, fingerprint, group_id, group_size) of each row of ``docs`` (doc_id, text).

    ``fingerprint`` is a hash of all samples of the embedding.
    """
    common.prepare(docs.sparkSession)
    node = F.when(F.length("text") > 0, F.xxhash64("text"))
    source = docs.select("doc_id", "text", node.alias("node"))
    texts = source.filter("node is not null").select("node", "text")
    # rows of copies are combined before the shuffle
    table = common.written(keys_of(texts, share, bands, gap).groupBy("band", "node", "whole").agg(F.min("size").alias("size")), "keys")
    rows = common.written(agreeing(table.filter("not whole")), "agreeing")
    prints = common.written(table.filter("whole").groupBy("node").agg(F.min("band").alias("fingerprint")), "prints")
    common.discard(table)
    sketched = common.written(sketches(texts, common.written(rows.select("node").distinct(), "nodes")), "sketches")
    tried = common.written(stars(rows, share), "stars")
    first = verified(common.written(possible(tried, sketched, share), "possible"), texts, share)
    rest = candidates(rows, graph.components(first), share)
    known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = common.written(rest.join(known, ["a", "b"], "left_anti"), "rest")
    roots = graph.components(first.union(verified_in_blocks(rest, texts, sketched.select("node", "size"), share)))
    rows = source.select("doc_id", "node").join(prints, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size"))
    return rows.join(groups, "root", "left").select("doc_id", "fingerprint", "group_id", "group_size")
