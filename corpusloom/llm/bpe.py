"""Byte-level BPE encoding and decoding (operator 8) by replaying merges over the words of many documents.

Documents are cut into words by the vocabulary's pattern, and all different words of a stretch of the corpus
are laid out as one array of symbols. An inverted index holds, for each token pair, the places where it
occurs. Every merge is then applied in rank order to all its places at once, after which only the pairs with
a touched neighbour are entered anew. Documents are the concatenation of their words' tokens, so nothing is
shuffled. Decoding maps tokens back to bytes and is compared with the text of every document.

The vocabulary file (base64 token, rank) is a parameter; it is read by the driver and broadcast (its size is
that of the vocabulary, whatever the corpus).

Defined results
    * a null text has null tokens and counts 0 tokens; an empty one has no tokens; both round-trip
    * one row for each row of ``docs``, repeated rows too; a null doc_id is passed on
    * special tokens are ordinary text; columns of other names aren't read
"""

from __future__ import annotations

import base64
import heapq
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common, text

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text whose words are replayed together, and words that are remembered within a task.
STRETCH, REMEMBERED = 4 << 20, 150_000
#: Bytes of new words that are laid out and replayed at once.
REPLAYED = 1 << 20
#: Bytes of text whose tokens are put out and decoded together.
PIECE = 1 << 20


class Vocabulary:
    """Tokens by id, ids of single bytes, and merges as sorted pair codes."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pattern = pattern
        size = max(ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.left, self.right = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        for token, rank in ranks.items():
            if len(token) > 1:
                a, b = _halves(token, ranks, rank)
                self.left[rank], self.right[rank] = a, b
        made = np.flatnonzero(self.left >= 0)
        codes = self.left[made].astype(np.int64) << 32 | self.right[made]
        order = np.argsort(codes)
        self.codes, self.ranks = codes[order], made[order].astype(np.int32)
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, -1 where there is none."""
        code = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], -1)

    def decode(self, tokens: np.ndarray) -> np.ndarray:
        """Bytes of a run of tokens."""
        return self.bytes[ragged(self.start[tokens], self.size[tokens])]


def _halves(token: bytes, ranks: dict[bytes, int], rank: int) -> tuple[int, int]:
    """The two tokens whose merge makes ``token``: what merges of lower rank leave of it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        options = [(ranks.get(a + b, rank), i) for i, (a, b) in enumerate(pairwise(parts))]
        r, i = min(options)
        if r >= rank:
            raise ValueError(f"token {token!r} isn't a merge of two tokens")
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return ranks[parts[0]], ranks[parts[1]]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all ranges ``starts[i] : starts[i] + sizes[i]`` one after another."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return np.empty(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)


def replay(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, offsets): the tokens of each word, by applying every merge in rank order to all words."""
    sizes = np.array([len(w) for w in words], np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8)
    n = len(raw)
    symbol = np.append(vocabulary.byte[raw], np.int32(-1))
    # place n is the neighbour of both ends of every word
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    ends = np.cumsum(sizes)
    some = sizes > 0
    after[ends[some] - 1] = n
    before[(ends - sizes)[some]] = n
    before = np.append(before, n)
    after[n:] = n
    places = np.flatnonzero(after[:n] != n)
    rank = vocabulary.rank(symbol[places], symbol[after[places]])
    places, rank = places[rank >= 0], rank[rank >= 0]
    index: dict[int, list[np.ndarray]] = {}
    pending: list[int] = []

    def enter(places: np.ndarray, rank: np.ndarray) -> None:
        if not len(places):
            return
        order = np.argsort(rank, kind="stable")
        places, rank = places[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, own in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts), strict=True):
            if r in index:
                index[r].append(own)
            else:
                index[r] = [own]
                heapq.heappush(pending, r)

    enter(places, rank)
    while pending:
        r = heapq.heappop(pending)
        lists = index.pop(r)
        at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
        left, right = vocabulary.left[r], vocabulary.right[r]
        at = at[(symbol[at] == left) & (symbol[after[at]] == right)]
        if left == right and len(at) > 1:
            # of overlapping places, from the left, every second
            chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
            run = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        follows = after[gone]
        symbol[at] = r
        symbol[gone] = -1
        after[at] = follows
        before[follows] = at
        before[n] = n
        precedes = before[at]
        x = precedes[precedes != n]
        y = at[follows != n]
        touched = np.concatenate([x, y])
        if len(touched):
            found = vocabulary.rank(symbol[touched], symbol[after[touched]])
            live = found >= 0
            enter(touched[live], found[live])
    alive = symbol[:n] >= 0
    offsets = np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], ends])]
    return symbol[:n][alive], offsets


class _Numbers(dict):
    """Numbers of words in order of first appearance."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Encoder:
    """Encodes documents of a task; remembers the tokens of words it has seen."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.find = regex.compile(vocabulary.pattern).findall
        self.forget()

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.tokens = np.empty(0, np.int32)
        self.offsets = np.zeros(1, np.int64)

    def words(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of the words of each document; words that are new are replayed."""
        if len(self.numbers) > REMEMBERED:
            self.forget()
        known, number = len(self.numbers), self.numbers.__getitem__
        words = [np.fromiter(map(number, self.find(t)), np.int32) for t in texts]
        if len(self.numbers) > known:
            new, size, tokens, offsets = [], 0, [self.tokens], [self.offsets]
            have = len(self.tokens)
            for w in islice(self.numbers, known, None):
                new.append(w.encode())
                size += len(new[-1])
                if size >= REPLAYED or len(new) + known == len(self.numbers):
                    known += len(new)
                    own, ends = replay(new, self.vocabulary)
                    tokens.append(own)
                    offsets.append(ends[1:] + have)
                    have += len(own)
                    new, size = [], 0
            self.tokens, self.offsets = np.concatenate(tokens), np.concatenate(offsets)
        return words

    def join(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, offsets) of documents given by their words."""
        flat = np.concatenate(words) if words else np.empty(0, np.int32)
        starts = self.offsets[flat]
        sizes = self.offsets[flat + 1] - starts
        total = np.concatenate([[0], np.cumsum(sizes)])
        return self.tokens[ragged(starts, sizes)], total[np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, offsets) of the documents."""
        return self.join(self.words(texts))


def _same(vocabulary: Vocabulary, tokens: np.ndarray, offsets: np.ndarray, piece: text.Chunk) -> np.ndarray:
    """Whether the tokens of each document decode to its bytes."""
    decoded = vocabulary.decode(tokens)
    ends = np.concatenate([[0], np.cumsum(vocabulary.size[tokens])])[offsets]
    if np.array_equal(ends, piece.offsets) and np.array_equal(decoded, piece.data):
        return np.ones(piece.n, np.bool_)
    return np.array([np.array_equal(decoded[ends[i] : ends[i + 1]], piece.data[piece.offsets[i] : piece.offsets[i + 1]]) for i in range(piece.n)], np.bool_)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip) of each row of ``docs``."""
    common.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary, pattern))

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in text.gathered(batches, "text", STRETCH):
            column = batch.column("text")
            for chunk in text.chunks(column, 2 * STRETCH):
                words = encoder.words([t or "" for t in column.slice(chunk.rows.start, chunk.n).to_pylist()])
                for piece in text.chunks(column.slice(chunk.rows.start, chunk.n), PIECE):
                    tokens, offsets = encoder.join(words[piece.rows])
                    at = chunk.rows.start + piece.rows.start
                    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens), mask=column.slice(at, piece.n).is_null())
                    same = _same(encoder.vocabulary, tokens, offsets, piece)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, piece.n), pa.array(np.diff(offsets)), lists, pa.array(same)], names=["doc_id", "n_tokens", "tokens", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.in_python(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, tokens array<int>, round_trip boolean")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, text) of (doc_id, tokens); null tokens give null, bytes that aren't UTF-8 the replacement sign."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary, pattern))

    @F.pandas_udf("string")
    def joined(tokens):
        v: Vocabulary = shared.value
        return tokens.map(lambda t: None if t is None else v.decode(np.asarray(t, np.int64)).tobytes().decode("utf-8", "replace"))

    return encoded.select("doc_id", joined("tokens").alias("text"))
