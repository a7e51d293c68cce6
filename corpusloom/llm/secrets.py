"""Secret scan (operator 1): guess cost of values in credential context.

A value counts if it follows a credential word (password, token, api_key, ...) and ``=``, ``:``, ``=>`` or
``:=``; the word of an authentication scheme (Bearer, Basic, Token, Digest) before a value isn't part of it. What
follows ``Bearer`` without a mark counts if it looks like a token and not like a word of prose: it has a digit,
a capital after a small letter, or 20 characters at least.

The value's cost is the least total, over all ways to cut it into spans, of the logarithm (base 10) of the
guesses that each span takes: dictionary words (with capitals, character swaps or reversed), dates and
years, repeats of a unit of at most ``UNIT`` characters (from any place, any number of times), runs of
neighbouring characters and walks over a keyboard with all their parts, and brute-force spans over the character
classes that the value has. Dynamic programming over the end of the last span; a value is a secret if the
cheapest way takes at least ``10 ** SECRET`` guesses. The dictionary is a list of common passwords, then the
words of a public vocabulary, whose file is a parameter; the driver reads and broadcasts it.

Defined results
    * null and empty texts have no values; a value shorter than ``LEAST`` characters isn't one
    * a row for each value of each row of ``docs``: repeated rows and repeated values are repeated; an empty
      table gives an empty result
    * ties of segmentations go to the fewest spans; very long texts and values are scanned whole, in time that
      grows with their length
    * places are counted in characters; a value goes to the closing quote if it is quoted, else to a space,
      quote, comma, semicolon, bracket or the end of the text; it never crosses a document
    * ``redact`` replaces secrets by ``REPLACEMENT`` and sets n_chars, if there is such a column; other columns,
      whatever their names, pass through
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from functools import cached_property, lru_cache
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common, text

#: Public vocabulary whose words, by rank, follow the common ones in the dictionary.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Longest unit of a repeat that a guesser tries.
UNIT = 64
LEAST = 4
SECRET = 8.0
REPLACEMENT = "[REDACTED]"
#: Years from which a guesser counts, and the least span of years that it tries.
THIS_YEAR, YEARS = 2025, 20

CONTEXT = re.compile(rb"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|authorization|auth|bearer|(?:api|access|private|secret|encryption|signing|auth|account|client)[ _.-]?(?:key|token|secret|id)|apikey)[\"'\])]{0,2}\s{0,3}$", re.I)
VALUE = re.compile(rb"[:=]?[=>]?\s{0,3}(?:(?i:bearer|basic|token|digest)\s{1,3}(?![a-z]+=[\"']))?(?:\"([^\"\r\n]{4,})\"|'([^'\r\n]{4,})'|`([^`\r\n]{4,})`|([^\s\"'`,;<>()\[\]{}]{4,}))")
BEARER = re.compile(rb"(?<![^\W_])(?i:bearer)[ \t]{1,3}[\"'`]?(?=[a-z0-9._~+/-]*(?:[0-9]|[a-z][A-Z])|[A-Z0-9._~+/-]*[0-9]|[A-Za-z0-9._~+/-]{20})([A-Za-z0-9][A-Za-z0-9._~+/-]{3,}=*)")

#: Common passwords and words of passwords, most frequent first.
WORDS = """password 123456 qwerty admin welcome letmein login master secret dragon monkey football baseball abc123 iloveyou
trustno1 sunshine princess shadow superman batman hello freedom whatever michael jordan jennifer hunter charlie andrew
test user guest root default changeme example sample demo temp temporary pass passwd key token api access private public
summer winter spring autumn january february march april may june july august september october november december monday
tuesday wednesday thursday friday saturday sunday love money power magic secure security private server system manager
database oracle mysql postgres redis linux windows apple google amazon computer internet network service account mail
email office company business home house family mother father brother sister baby angel lovely flower cookie coffee pepper
ginger orange banana cheese chocolate killer ninja warrior soccer hockey tennis golf player game gamer star wars matrix
london paris berlin madrid rome newyork texas boston chicago dallas america canada germany france spain italy the and you
that was for are with his they this have from one had word but not what all were when your can said there use each which
she how their will other about out many then them these some her would make like him into time has look two more write
see number way could people than first water been call who now find long down day did get come made part enter null none
undefined your here insert replace placeholder value string dummy foo bar baz qux xxx todo redacted correct horse battery
staple blue green red black white yellow silver gold tiger lion eagle wolf bear horse dog cat bird fish""".split()
_SWAPS = str.maketrans("@4380157$+!", "aaeboistsii"[:11])
_ROWS = ["`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"]
_SHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./", strict=True))
_PLACE = {c: (2 * i + r, r) for r, row in enumerate(_ROWS) for i, c in enumerate(row)}
_DATE = re.compile(r"(?:(\d{4})([-/._]?)(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/._]?)(\d{1,2})\6(\d{4}|\d{2}))")


def _beside(a: str, b: str) -> tuple[int, int] | None:
    """Step on the keyboard from ``a`` to ``b`` if the keys touch."""
    if a not in _PLACE or b not in _PLACE or a == b:
        return None
    (x, r), (y, s) = _PLACE[a], _PLACE[b]
    return (y - x, s - r) if abs(s - r) <= 1 and abs(y - x) <= 2 else None


def _case_cost(word: str) -> float:
    upper = sum(c.isupper() for c in word)
    if not upper or word == word.lower():
        return 0.0
    if upper in (1, len(word)) and (word[0].isupper() or word[-1].isupper()):
        return math.log10(2)
    return math.log10(sum(math.comb(len(word), k) for k in range(1, min(upper, len(word) - upper) + 1)) or 2)


def _date_cost(piece: str) -> float | None:
    """Cost of a date, or none if ``piece`` isn't one."""
    if piece.isdecimal() and len(piece) == 4 and piece[:2] in ("19", "20"):
        return math.log10(max(YEARS, abs(THIS_YEAR - int(piece))))
    m = _DATE.fullmatch(piece)
    if not m:
        return None
    year, a, b = (m[1], m[3], m[4]) if m[1] else (m[8], m[5], m[7])
    a, b = int(a), int(b)
    if not (1 <= a <= 31 and 1 <= b <= 31 and min(a, b) <= 12):
        return None
    full = int(year) if len(year) == 4 else 2000 + int(year) if int(year) < 50 else 1900 + int(year)
    if not 1900 <= full <= 2100:
        return None
    return math.log10(365 * max(YEARS, abs(THIS_YEAR - full))) + (math.log10(4) if m[2] or m[6] else 0)


class Dictionary:
    """Ranked words as automata that find all of them in one pass over a value."""

    def __init__(self, words: list[str]) -> None:
        self.words = list(dict.fromkeys(w for w in words if len(w) >= 3))

    def __getstate__(self) -> dict:
        return {"words": self.words}

    @cached_property
    def automata(self) -> tuple:
        """Of the words, and of the words read backwards."""
        out = ahocorasick.Automaton(), ahocorasick.Automaton()
        for rank, word in enumerate(self.words, 1):
            out[0].add_word(word, (len(word), rank))
            out[1].add_word(word[::-1], (len(word), rank))
        for automaton in out:
            automaton.make_automaton()
        return out

    def found(self, low: str, backwards: bool = False):
        """Yield (start, end, rank) of each word in ``low``."""
        if self.words:
            for last, (size, rank) in self.automata[backwards].iter(low):
                yield last + 1 - size, last + 1, rank


COMMON = Dictionary(WORDS)


@lru_cache(maxsize=4)
def dictionary(vocabulary: str | None = VOCABULARY) -> Dictionary:
    """The common words, then the words of a public vocabulary (lines of base64 token and rank) by rank."""
    if vocabulary is None:
        return COMMON
    with open(vocabulary, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    tokens = (token.decode("utf-8", "ignore").strip().lower() for _, token in ranked)
    return Dictionary(WORDS + [t for t in tokens if t.isalpha()])


def spans(value: str, words: Dictionary = COMMON) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, cost) of every word and date in ``value``."""
    out: list[tuple[int, int, str, float]] = []
    low = value.lower()
    n = len(value)
    if len(low) != n:
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    swapped = low.translate(_SWAPS)
    for found, extra in ((words.found(low), 0.0), (words.found(low, True), math.log10(2))):
        out += [(i, j, "word", math.log10(rank + 1) + extra + _case_cost(value[i:j])) for i, j, rank in found]
    if swapped != low:
        out += [(i, j, "word", math.log10(rank + 1) + math.log10(2) + _case_cost(value[i:j])) for i, j, rank in words.found(swapped) if swapped[i:j] != low[i:j]]
    for i in range(n):
        if value[i].isdecimal():
            for size in (4, 6, 7, 8, 9, 10):
                if i + size <= n and value[i + size - 1].isdecimal() and (cost := _date_cost(value[i : i + size])) is not None:
                    out.append((i, i + size, "date", cost))
    return out


class Stretch:
    """A stretch whose every part is a span: one of neighbouring characters, a walk, or a repeat.

    A part's cost is ``own[start] + shared[end] + log10(length)`` with a start's ``own`` set when it is entered. Of
    two starts the later one wins at first, if ever, and never again once it has lost, as the logarithm is concave;
    so losers are forgotten and the starts kept are few.
    """

    __slots__ = ("kind", "least", "live", "unit")

    def __init__(self, kind: str, least: int, unit: int = 1) -> None:
        self.kind, self.least, self.unit = kind, least, unit
        self.live: list[tuple[float, int, int]] = []

    def enter(self, cost: float, number: int, start: int) -> None:
        self.live.append((cost, number, start))

    def best(self, end: int) -> tuple[float, int, int] | None:
        """(cost without the shared part, spans, start) of the cheapest part that ends at ``end``."""
        keep, top = [], None
        for cost, number, start in self.live:
            if end - start < self.least:
                keep.append((cost, number, start))
                continue
            total = cost + math.log10((end - start) // self.unit)
            if top is None or (total, number) < top[:2]:
                top = total, number, start
                keep.append((cost, number, start))
        self.live = keep
        return top


def _stretches(value: str, n: int, low: str):
    """(sequences, walks): stretches as (start, end, steps) of neighbouring characters and of touching keys."""
    steps = [ord(b) - ord(a) for a, b in pairwise(value)]
    sequences, i = [], 0
    while i < n - 1:
        j = i + 1
        while j < n - 1 and steps[j] == steps[i]:
            j += 1
        if j - i >= 2 and abs(steps[i]) in (1, 2):
            sequences.append((i, j + 1, steps[i]))
        i = j
    keys = [_SHIFTED.get(c, c) for c in low]
    ways = [_beside(a, b) for a, b in pairwise(keys)]
    walks, i = [], 0
    while i < n - 1:
        j = i
        while j < n - 1 and ways[j]:
            j += 1
        if j - i >= 3:
            turns = [0]
            for k in range(i + 1, j):
                turns.append(turns[-1] + (ways[k] != ways[k - 1]))
            walks.append((i, j + 1, turns))
        i = max(j, i + 1)
    return sequences, walks


def repeats(value: str) -> list[tuple[int, int, int]]:
    """(start, end, period) of all maximal stretches of at least two periods and 3 characters, of up to ``UNIT``
    characters a period, whose unit isn't itself a repeat."""
    code = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, out = len(code), []
    for p in range(1, min(UNIT, n // 2) + 1):
        same = np.concatenate([[0], (code[p:] == code[:-p]).astype(np.int8), [0]])
        change = np.diff(same)
        for i, j in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True):
            if j - i >= p and j - i + p >= 3:
                unit = value[i : i + p]
                if (unit + unit).find(unit, 1) == p:
                    out.append((i, j + p, p))
    return out


def guess_cost(value: str, words: Dictionary = COMMON, depth: int = 0) -> tuple[float, list[tuple[int, int, str]]]:
    """Least log10 of guesses, and the spans (start, end, kind) of a cheapest segmentation.

    Ties go to the fewest spans. Brute-force spans cost the logarithm of the sizes of the value's character
    classes for each character. Time grows in proportion to the length, but for the number of words found.
    """
    n = len(value)
    if not n:
        return 0.0, []
    size = 0
    some = set(value)
    if any(c.isdecimal() for c in some):
        size += 10
    letters = [c for c in some if c.isascii() and c.isalpha()]
    if any(c.islower() for c in letters):
        size += 6 if all(c in "abcdef" for c in letters if c.islower()) and n >= 8 else 26
    if any(c.isupper() for c in letters):
        size += 6 if all(c in "ABCDEF" for c in letters if c.isupper()) and n >= 8 else 26
    if any(not c.isalnum() for c in some):
        size += 33
    if any(not c.isascii() for c in some):
        size += 100
    each = math.log10(max(size, 10))
    ending: dict[int, list[tuple[int, str, float]]] = {}
    for i, j, kind, cost in spans(value, words):
        ending.setdefault(j, []).append((i, kind, cost))
    low = value.lower()
    sequences, walks = _stretches(value, n, low if len(low) == n else value)
    # stretches as (start, end, cost of a start, shared cost of an end, Stretch); each has its turn from start to end
    turn = math.log10(4.6)
    begin: dict[int, list[tuple]] = {}
    for i, j, step in sequences:
        base = 0.0 if step == 1 else math.log10(2)
        begin.setdefault(i, []).append((j, lambda a, base=base: base + math.log10(4 if value[a] in "aA01zZ9" else 26), lambda b: 0.0, [Stretch("sequence", 3)]))
    for i, j, turns in walks:
        begin.setdefault(i, []).append((j, lambda a, i=i, turns=turns: math.log10(47) + turn * (1 - turns[min(a - i, len(turns) - 1)]), lambda b, i=i, turns=turns: turn * turns[b - i - 2], [Stretch("keyboard", 4)]))
    inner: dict[str, float] = {}

    def unit_cost(unit: str) -> float:
        if unit not in inner:
            inner[unit] = guess_cost(unit, words, 1)[0]
        return inner[unit]

    for i, j, p in repeats(value) if depth == 0 else ():
        # a part is whole units, so the starts and ends of each place within the unit are a stretch of their own
        begin.setdefault(i, []).append((j, lambda a, p=p: unit_cost(value[a : a + p]), lambda b: 0.0, [Stretch("repeat", max(2 * p, 3), p) for _ in range(p)]))
    best: list[tuple[float, int]] = [(0.0, 0)]
    back: list[tuple[int, str]] = [(0, "")]
    active: list[tuple] = []
    for j in range(n + 1):
        if j:
            joined = back[j - 1][1] == "brute"
            choice = (best[j - 1][0] + each, best[j - 1][1] + (not joined))
            origin = (back[j - 1][0] if joined else j - 1, "brute")
            for i, kind, cost in ending.get(j, ()):
                other = (best[i][0] + cost, best[i][1] + 1)
                if other < choice:
                    choice, origin = other, (i, kind)
            for start, _, _, shared, parts in active:
                part = parts[(j - start) % len(parts)]
                if part.live and (top := part.best(j)):
                    other = (top[0] + shared(j), top[1] + 1)
                    if other < choice:
                        choice, origin = other, (top[2], part.kind)
            best.append(choice)
            back.append(origin)
        if active:
            active = [s for s in active if s[1] > j]
        active += [(j, *s) for s in begin.get(j, ())]
        for start, end, own, _, parts in active:
            part = parts[(j - start) % len(parts)]
            if end - j >= part.least:
                part.enter(best[j][0] + own(j), best[j][1], j)
    cut, j = [], n
    while j:
        i, kind = back[j]
        cut.append((i, j, kind))
        j = i
    return best[n][0], cut[::-1]


def _values(chunk: text.Chunk):
    """Yield (document, start, end, context) in bytes of each value in credential context."""
    data = chunk.data
    raw = data.tobytes()
    low, bearers = raw.lower(), []
    at = low.find(b"bearer")
    while at >= 0:
        bearers.append(at)
        at = low.find(b"bearer", at + 6)
    marks = np.union1d(np.flatnonzero((data == 61) | (data == 58)), np.array(bearers, np.int64))
    docs = np.searchsorted(chunk.offsets, marks, "right") - 1
    after = 0
    for at, d in zip(marks.tolist(), docs.tolist(), strict=True):
        if at < after:
            continue
        lo, hi = int(chunk.offsets[d]), int(chunk.offsets[d + 1])
        if raw[at] not in b":=":
            found = BEARER.match(raw, at, hi)
            if found:
                yield d, found.start(1), found.end(1), "bearer"
                after = found.end(1)
            continue
        context = CONTEXT.search(raw, max(lo, at - 40), at)
        if not context:
            continue
        found = VALUE.match(raw, at, hi)
        if found:
            group = found.lastindex
            yield d, found.start(group), found.end(group), context[0].strip(b" \"'])").decode().lower()
            after = found.end(group)


def _characters(raw: np.ndarray) -> int:
    return int(((raw & 0xC0) != 0x80).sum())


def credential_values(docs: DataFrame, secret: float = SECRET, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """(doc_id, start, length, context, guesses_log10, spans, digest, is_secret) for each value.

    The value itself isn't given; ``digest`` is the start of its SHA-256, ``spans`` the cheapest segmentation.
    """

    shared = docs.sparkSession.sparkContext.broadcast(dictionary(vocabulary))

    def scan(batches):
        known: Dictionary = shared.value
        for batch in batches:
            rows, out = [], []
            for chunk in text.chunks(batch.column("text")):
                for d, start, end, context in _values(chunk):
                    raw = chunk.data[start:end]
                    value = raw.tobytes().decode("utf-8", "replace")
                    cost, cut = guess_cost(value, known)
                    rows.append(chunk.rows.start + d)
                    out.append((_characters(chunk.data[chunk.offsets[d] : start]), len(value), context, round(cost, 6), " ".join(f"{kind}:{j - i}" for i, j, kind in cut), hashlib.sha256(raw.tobytes()).hexdigest()[:16], cost >= secret))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "start", "length", "context", "guesses_log10", "spans", "digest", "is_secret"])

    common.prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.in_python(docs.select("doc_id", "text"), scan, f"doc_id {kind}, start long, length long, context string, guesses_log10 double, spans string, digest string, is_secret boolean")


def redact(docs: DataFrame, secret: float = SECRET, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; same columns and rows."""

    common.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(vocabulary))

    @F.pandas_udf("string")
    def cleaned(texts):
        column = pa.Array.from_pandas(texts, type=pa.large_string())
        out = texts.copy()
        for chunk in text.chunks(column):
            cuts: dict[int, list[tuple[int, int]]] = {}
            for d, start, end, _ in _values(chunk):
                if guess_cost(chunk.data[start:end].tobytes().decode("utf-8", "replace"), shared.value)[0] >= secret:
                    cuts.setdefault(d, []).append((start, end))
            for d, some in cuts.items():
                at, parts = chunk.offsets[d], []
                for start, end in some:
                    parts += [chunk.data[at:start].tobytes().decode(), REPLACEMENT]
                    at = end
                out.iloc[chunk.rows.start + d] = "".join([*parts, chunk.data[at : chunk.offsets[d + 1]].tobytes().decode()])
        return out

    out = docs.withColumn("text", cleaned("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out
