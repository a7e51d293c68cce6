"""Vectorised text kit: word boundaries, hashes and n-gram codes over whole Arrow batches.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII bytes; hashes ignore the case of
ASCII and Latin-1 letters. Everything works on the bytes of many documents at once, so no Python code
runs for a single word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer document forms a chunk of its own.
CHUNK_BYTES = 2 << 20

IS_WORD = np.zeros(256, np.bool_)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20250117)
BYTE_VALUE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
WINDOW_BASE = 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.empty(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        return self.up, self.down


_BYTES, _WORDS = _Powers(BASE), _Powers(WINDOW_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_words(words: list[str]) -> np.ndarray:
    """Hashes of given words as ``Words.hash`` has them (a word with separators is cut at them)."""
    out = []
    for w in words:
        h = words_of(w.encode()).hash
        out.append(h[0] if len(h) else np.uint64(0))
    return np.array(out, np.uint64)


@dataclass
class Chunk:
    """Some documents: their rows in the batch, bytes one after another, and the place of each."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """All words of a chunk: byte positions, case-free hash, and words before each document."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # first[d]:first[d + 1] are the words of document d

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    if offsets is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a text column into chunks of whole documents."""
    data, offsets = string_buffers(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(n, max(at + 1, to))
        yield Chunk(slice(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def gathered(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Join neighbouring batches until their text has about ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    have = 0
    for batch in batches:
        held.append(batch)
        have += batch.column(column).nbytes
        if have >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, have = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 letters in lower case."""
    out = LOWER[data]
    if len(out) > 1:
        at = np.flatnonzero(data[:-1] == 0xC3) + 1
        if len(at):
            second = data[at]
            at = at[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]
            out[at] += 32
    return out


def words(chunk: Chunk) -> Words:
    data, offsets = chunk.data, chunk.offsets
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return Words(none, none, np.empty(0, np.uint64), np.zeros(len(offsets), np.int64))
    inside = IS_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    begins[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    up, down = _BYTES.get(n)
    sums = np.cumsum(BYTE_VALUE[lowered(data)] * up[:n])
    before = np.where(start > 0, sums[start - 1], np.uint64(0)) if len(start) else np.empty(0, np.uint64)
    return Words(start, end + 1, mix((sums[end] - before) * down[start]), np.searchsorted(start, offsets))


def words_of(text: bytes) -> Words:
    data = np.frombuffer(text, np.uint8)
    return words(Chunk(slice(0, 1), data, np.array([0, len(data)])))


def windows(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` neighbours in ``hashes`` (fewer than k give none)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _WORDS.get(len(hashes))
    values = mix(hashes ^ np.uint64(salt)) if salt else hashes
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(values * up[: len(hashes)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[:n])


def document_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each document's range; empty ranges give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[first[1:]] - total[first[:-1]]
