"""Toxic passages (operator 9): maximal scoring segments over token log-odds.

Log-odds of a word are those of occurring in a toxic rather than a clean labelled document, with an
informative Dirichlet prior: pseudo-counts in proportion to the word's document frequency in the whole
corpus. Words score ``-DRIFT`` and, if they differ from 0 by ``Z`` standard deviations, their log-odds.
Languages and topics differ somewhat in toxicity, so words with log-odds between 0 and ``ODDS`` count as neutral. All
counts are of different texts: each of k rows of one text counts 1 / k. Edited copies of one toxic text would
still make all its words look toxic, so a word only has a positive score if its toxic occurrences have many
contexts (pairs of neighbouring words): ``CONTEXTS`` of its different toxic texts at least. The linear-time scan of Ruzzo and Tompa finds all maximal scoring segments of a document.
Scores are calibrated as extreme values: lambda solves the Karlin-Altschul equation for the scores of clean
text, and K is fitted to the best segments of the clean labelled documents. A document's p-value is the least
that the sum statistic of its r best segments has over all r, each r weighted by 2**-r; the document is toxic
if that is at most ``ALPHA``. Passages are the segments whose own E-value is at most ``E_VALUE``.

Defined results
    * null and empty texts, and texts without words, have no segments, p-value 1, and aren't toxic
    * rows of one text that have different labels count as one toxic text
    * one row for each row of ``docs``; labels with null toxic count as unlabelled, a document with both
      labels as toxic; repeated label rows count once
    * without both kinds of labelled documents no word has a score and nothing is toxic
    * segments are given as word numbers (end exclusive) in order; segments of equal score keep that order
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common, text
from corpusloom.llm.vocabulary import in_document

PRIOR = 100.0
Z = 4.0
ODDS = 3.0
LEAST = 5
CONTEXTS = 0.25
DRIFT = 1.0
ALPHA = 1e-4
E_VALUE = 0.01


def _counts(docs: DataFrame) -> DataFrame:
    """(word, toxic, clean, all, clean_tokens): different texts with the word by label, and its tokens in clean ones.

    ``docs`` has the ``label`` of each row's text and its ``share``, 1 by the number of rows of that text.
    """

    def count(batches):
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def merged():
            words = np.concatenate([p[0] for p in parts])
            values = np.concatenate([p[1] for p in parts])
            at, unique = pd.factorize(words)
            return unique, np.stack([np.bincount(at, values[:, k], len(unique)) for k in range(4)], 1)

        for batch in batches:
            labels = batch.column("label").fill_null(-1).to_numpy(zero_copy_only=False)
            shares = batch.column("share").to_numpy()
            for chunk in text.chunks(batch.column("text")):
                w = text.words(chunk)
                at, unique = pd.factorize(w.hash)
                label = np.repeat(labels[chunk.rows], np.diff(w.first))
                share = np.repeat(shares[chunk.rows], np.diff(w.first))
                once = np.zeros(len(w.hash), np.bool_)
                once[in_document(w)] = True
                n = len(unique)
                values = [np.bincount(at[mask], share[mask], n) for mask in (once & (label == 1), once & (label == 0), once, label == 0)]
                parts.append((unique, np.stack(values, 1)))
                held += n
                if held > 2_000_000:
                    parts = [merged()]
                    held = len(parts[0][0]) // 2
        if parts:
            unique, values = merged()
            for at in range(0, len(unique), 100_000):
                to = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(unique[to].view(np.int64)), *(pa.array(np.ascontiguousarray(values[to, k])) for k in range(4))], names=["word", "toxic", "clean", "every", "clean_tokens"])

    found = common.in_python(docs.select("text", "label", "share"), count, "word long, toxic double, clean double, every double, clean_tokens double")
    # the shares of a text's rows add up to whole numbers
    return found.groupBy("word").agg(*(F.round(F.sum(c)).cast("long").alias(c) for c in ("toxic", "clean", "every", "clean_tokens")))


def log_odds(counts: DataFrame, toxic: int, clean: int, total: int) -> DataFrame:
    """(word, odds, clean_tokens) of the words whose log-odds are significant."""
    prior = F.col("every") * (PRIOR / max(total, 1))
    t, c = F.col("toxic") + prior, F.col("clean") + prior
    # documents without the word, and the prior's
    odds = F.log(t / (toxic + PRIOR - t + 1)) - F.log(c / (clean + PRIOR - c + 1))
    spread = F.sqrt(1 / t + 1 / c)
    scored = counts.filter(F.col("toxic") + F.col("clean") >= LEAST).select("word", odds.alias("odds"), (odds / spread).alias("z"), "toxic", F.expr(f"(clean + {PRIOR / max(total, 1)} * every) / {clean + PRIOR}").alias("clean_share"))
    return scored.filter((F.abs("z") >= Z) & ((F.col("odds") < 0) | (F.col("odds") >= ODDS)))


def varied(docs: DataFrame, candidates: pd.DataFrame) -> np.ndarray:
    """Which of the candidates (word, toxic) have enough different contexts in toxic documents."""
    order = np.argsort(candidates.word.to_numpy(np.int64).view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(candidates.word.to_numpy(np.int64).view(np.uint64)[order])

    def contexts(batches):
        known = shared.value
        for batch in batches:
            for chunk in text.chunks(batch.column("text")):
                w = text.words(chunk)
                if not len(w.hash) or not len(known):
                    continue
                at = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
                places = np.flatnonzero(known[at] == w.hash)
                last = len(w.hash) - 1
                inside = w.doc[places]
                left = np.where(places > w.first[inside], w.hash[np.maximum(places - 1, 0)], np.uint64(1))
                right = np.where(places + 1 < w.first[inside + 1], w.hash[np.minimum(places + 1, last)], np.uint64(2))
                pairs = np.unique(np.stack([w.hash[places], text.mix(left * np.uint64(3) + text.mix(right))], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in range(2)], names=["word", "context"])

    found = common.in_python(docs.filter("toxic = 1").select("text"), contexts, "word long, context long")
    n = found.distinct().groupBy("word").agg(F.count("*").alias("n")).toArrow().to_pandas().set_index("word").n
    return candidates.word.map(n).fillna(0).to_numpy() >= np.maximum(CONTEXTS * candidates.toxic.to_numpy(), 3)


def karlin_lambda(scores: np.ndarray, shares: np.ndarray) -> float:
    """Positive root of sum(shares * exp(lambda * scores)) = 1, for a negative mean and a positive score."""
    lo, hi = 1e-6, 1.0
    value = lambda x: float((shares * np.exp(np.minimum(x * scores, 700))).sum())
    while value(hi) < 1:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 1 else (lo, mid)
    return (lo + hi) / 2


def maximal_segments(before: list[float], after: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring segments as (first, last) of the positive scores, whose running sums are given.

    ``before[i]`` and ``after[i]`` are the sums before and after the i-th positive score.
    """
    held: list[tuple[float, float, int, int, int]] = []
    for i, (left, right) in enumerate(zip(before, after, strict=True)):
        first = i
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= left:
                j = held[j][4]
            if j < 0 or held[j][1] >= right:
                held.append((left, right, first, i, j))
                break
            left, first = held[j][0], held[j][2]
            del held[j:]
    return [(h[2], h[3]) for h in held]


def _segments(docs: DataFrame, words: np.ndarray, odds: np.ndarray) -> DataFrame:
    """(doc_id, toxic, n_words, segments) with segments array<struct<start, end, score>>."""
    order = np.argsort(words.view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast((words.view(np.uint64)[order], odds[order]))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scan(batches):
        known, score = shared.value
        bits = 1 << 20
        maybe = np.zeros(bits, np.bool_)
        maybe[(known & np.uint64(bits - 1)).astype(np.int64)] = True
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            out: list[list] = [[] for _ in range(batch.num_rows)]
            for chunk in text.chunks(batch.column("text")):
                w = text.words(chunk)
                n_words[chunk.rows] = np.diff(w.first)
                if not len(known) or not len(w.hash):
                    continue
                places = np.flatnonzero(maybe[(w.hash & np.uint64(bits - 1)).astype(np.int64)])
                at = np.minimum(np.searchsorted(known, w.hash[places]), len(known) - 1)
                hit = known[at] == w.hash[places]
                places, value = places[hit], score[at[hit]]
                first = np.searchsorted(places, w.first)
                for d in np.flatnonzero(np.diff(first)):
                    own = slice(first[d], first[d + 1])
                    place, s = places[own] - w.first[d], value[own]
                    after = np.cumsum(s) - DRIFT * (place - np.arange(len(place)))
                    up = np.flatnonzero(s > 0)
                    if not len(up):
                        continue
                    place, before, after = place[up], (after - s)[up], after[up]
                    out[chunk.rows.start + d] = [{"start": int(place[a]), "end": int(place[b]) + 1, "score": float(after[b] - before[a])} for a, b in maximal_segments(before.tolist(), after.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(n_words), pa.array(out, kind)], names=["doc_id", "toxic", "n_words", "segments"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return common.in_python(docs, scan, f"doc_id {id_type}, toxic int, n_words long, segments array<struct<start:long,end:long,score:double>>")


def toxic_passages(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, n_words, score, p_value, is_toxic, passages) of each row of ``docs``.

    ``passages`` has (start, end, score, e_value) of each significant segment.
    """
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    source = docs.select("doc_id", "text").join(common.small(known.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "toxic")
    copies = source.groupBy(F.xxhash64("text").alias("_text")).agg(F.count("*").alias("_rows"), F.max("toxic").alias("_label")).filter("_rows > 1")
    copies = common.written(copies, "copies")
    texts = source.join(common.small(copies), F.xxhash64("text") == F.col("_text"), "left")
    texts = texts.select("text", F.when(F.col("_rows").isNull(), F.col("toxic")).otherwise(F.col("_label")).alias("label"), (1 / F.coalesce("_rows", F.lit(1))).alias("share"))
    counts = common.written(_counts(texts), "odds")
    sizes = texts.agg(*(F.sum(F.when(c, F.col("share")).otherwise(0.0)) for c in (F.col("label") == 1, F.col("label") == 0, F.lit(True)))).first()
    toxic, clean, total = (round(x or 0) for x in sizes)
    model = pd.DataFrame({"word": [], "odds": [], "toxic": [], "clean_share": []})
    if toxic and clean:
        model = log_odds(counts, toxic, clean, total).toArrow().to_pandas()
        model = model[(model.odds < 0) | varied(source, model)]
    words, odds = model.word.to_numpy(np.int64), model.odds.to_numpy(np.float64) - DRIFT
    tokens = counts.agg(F.sum("clean_tokens")).first()[0] or 0
    segments = common.written(_segments(source, words, odds), "segments")
    rate = 1.0
    if (odds > 0).any():
        # shares of the scores among the tokens of clean text, with the prior
        shares = model.clean_share.to_numpy(np.float64) * (clean / max(tokens, 1))
        rest = max(1 - shares.sum(), 0.0)
        rate = karlin_lambda(np.append(odds, -DRIFT), np.append(shares, rest))
    top = F.coalesce(F.array_max(F.transform("segments", lambda x: x.score)), F.lit(0.0))
    fitted = segments.filter("toxic = 0 and n_words > 0").agg(F.count("*") / F.sum(F.col("n_words") * F.exp(-rate * top))).first()[0]
    k = fitted or 1.0
    e_value = lambda s: k * F.col("n_words") * F.exp(-rate * s)
    # log p of the r best: -t + (r - 1) log t - log r! - log (r - 1)! + r log 2, with t the sum of lambda S - log K n
    steps = f"""aggregate(
        sort_array(transform(segments, x -> {rate}D * x.score - ln({k}D * n_words)), false),
        named_struct('t', 0D, 'r', 0D, 'fact', 0D, 'best', 0D),
        (a, x) -> named_struct('t', a.t + x, 'r', a.r + 1D, 'fact', a.fact + ln(a.r + 1D) + if(a.r > 0D, ln(a.r), 0D),
            'best', if(a.t + x > 1D, least(a.best, -(a.t + x) + a.r * ln(a.t + x) - a.fact - ln(a.r + 1D) - if(a.r > 0D, ln(a.r), 0D) + (a.r + 1D) * ln(2D)), a.best)),
        a -> exp(a.best))"""
    best = F.when(F.size("segments") > 0, F.expr(steps)).otherwise(1.0)
    passages = F.filter(F.transform("segments", lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.score.alias("score"), e_value(x.score).alias("e_value"))), lambda x: x.e_value <= E_VALUE)
    return segments.select("doc_id", "n_words", top.alias("score"), best.alias("p_value"), (best <= alpha).alias("is_toxic"), passages.alias("passages"))
