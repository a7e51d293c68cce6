"""Language identification (operator 5): string kernels with Nystroem landmarks and kernel ridge regression.

The kernel of two documents is the mean over n = 1, 2, 3 of the share of byte n-grams that both have,
``|A & B| / sqrt(|A| |B|)`` (presence, not counts; case of ASCII letters aside; n-grams of two and three bytes
are hashed to ``SIZES`` cells). ``LANDMARKS`` documents span the Nystroem feature space; a ridge regression
against the rest is solved for each language on a sample of at most ``SAMPLE`` labelled rows a language,
which is the only bound here. All documents are scored whole, in batches, by products of their presence
matrix with the landmarks' and of the resulting features with the weights.

Defined results
    * null and empty texts have a null language, score and margin
    * one row for each row of ``docs``; ties of scores go to the language first in the alphabet
    * rows with a null label aren't trained on; without any labelled text all languages are null
    * with a single language every document gets it, margin null
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import common, text

SIZES = (256, 4096, 8192)
LANDMARKS = 64
#: Labelled rows of each language that the classifier is fitted on.
SAMPLE = 150
RIDGE = 1e-3
ROWS = 64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def presence(chunk: text.Chunk) -> np.ndarray:
    """(documents, sum(SIZES)) of 0 and 1, each order's part divided by the root of its number of n-grams."""
    n, width = chunk.n, sum(SIZES)
    out = np.zeros((n, width), np.float32)
    if not len(chunk.data):
        return out
    flat = out.reshape(-1)
    folded = _FOLD[chunk.data].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64) * width, np.diff(chunk.offsets))
    code, offset = folded, 0
    for order, size in enumerate(SIZES):
        if order:
            code = (code[:-1] << np.uint32(8)) | folded[order:]
        # cells by a multiplicative hash; n-grams that reach into the next document don't count
        cell = code if size == 256 else (code * np.uint32(2654435761)) >> np.uint32(32 - size.bit_length() + 1)
        at = row[: len(cell)] + (cell.astype(np.int64) + offset)
        if order and n > 1:
            inside = row[: len(cell)] == row[order:]
            at = at[inside]
        flat[at] = 1
        offset += size
    offset = 0
    for size in SIZES:
        part = out[:, offset : offset + size]
        part /= np.sqrt(np.maximum(part.sum(1, keepdims=True), 1))
        offset += size
    return out


def _features(column: pa.Array, landmarks: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Nystroem features of each document."""
    out = np.zeros((len(column), root.shape[1]), np.float32)
    for chunk in text.chunks(column):
        for at in range(0, chunk.n, ROWS):
            offsets = chunk.offsets[at : at + ROWS + 1]
            part = text.Chunk(slice(0, 0), chunk.data[offsets[0] : offsets[-1]], offsets - offsets[0])
            rows = slice(chunk.rows.start + at, chunk.rows.start + at + part.n)
            out[rows] = (presence(part) @ landmarks.T / np.float32(len(SIZES))) @ root
    return out


class Classifier:
    """Landmarks, Nystroem map and weights; fitted on the driver from the bounded sample."""

    def __init__(self, texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> None:
        self.langs = sorted(set(langs))
        column = pa.array(texts, pa.large_string())
        # landmarks of all languages in turn
        seen: dict[str, int] = {}
        turn = []
        for i, lang in enumerate(langs):
            turn.append((seen.setdefault(lang, 0), lang, i))
            seen[lang] += 1
        chosen = [i for _, _, i in sorted(turn)[: max(landmarks, 2 * len(self.langs))]]
        self.landmarks = np.concatenate([presence(c) for c in text.chunks(column.take(pa.array(chosen)))])
        gram = self.landmarks @ self.landmarks.T / len(SIZES)
        values, vectors = np.linalg.eigh(gram.astype(np.float64))
        keep = values > 1e-6 * values[-1]
        self.root = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
        x = np.hstack([_features(column, self.landmarks, self.root), np.ones((len(texts), 1), np.float32)]).astype(np.float64)
        y = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        self.weights = np.linalg.solve(x.T @ x + ridge * len(texts) * np.eye(x.shape[1]), x.T @ y)

    def scores(self, column: pa.Array) -> np.ndarray:
        return _features(column, self.landmarks, self.root) @ self.weights[:-1] + self.weights[-1]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Classifier | None:
    """Classifier from at most ``sample`` rows (text, lang) of each language, chosen by a hash of the text."""
    labelled = docs.select("text", "lang", F.xxhash64("text").alias("h")).filter("lang is not null and length(text) > 0")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    # first thinned to about four times the sample, so that no language is sorted as a whole
    bound = F.least(F.lit(1.0), 4.0 * sample / F.col("n")) * 2.0**63
    some = labelled.join(common.small(counts), "lang").filter(F.abs(F.col("h").cast("double")) <= bound)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    rows = some.withColumn("rank", rank).filter(F.col("rank") <= sample).orderBy("lang", "rank").select("text", "lang").collect()
    return Classifier([r.text for r in rows], [r.lang for r in rows]) if rows else None


def identify(docs: DataFrame, training: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, lang, predicted, score, margin) of each row of ``docs``; trained on ``training`` or ``docs``."""
    common.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs if training is None else training, sample))

    def run(batches):
        model: Classifier | None = shared.value
        for batch in batches:
            column = batch.column("text")
            _, offsets = text.string_buffers(column)
            none = np.diff(offsets) == 0
            if model is None:
                none[:] = True
            langs = np.array(model.langs if model else ["und"], object)
            scores = model.scores(column) if model else np.zeros((batch.num_rows, 1))
            best = scores.argmax(1) if batch.num_rows else np.empty(0, np.int64)
            top = scores[np.arange(len(best)), best]
            rest = np.partition(scores, -2, axis=1)[:, -2] if len(langs) > 1 else top
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(langs[best], pa.string(), mask=none), pa.array(top, pa.float64(), mask=none), pa.array(top - rest, pa.float64(), mask=none | (len(langs) < 2))], names=["doc_id", "lang", "predicted", "score", "margin"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.in_python(docs.select("doc_id", "text", "lang"), run, f"doc_id {kind}, lang string, predicted string, score double, margin double")
