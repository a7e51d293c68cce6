"""Quality classifier (operator 10): interpolated modified Kneser-Ney over bytes of trusted text.

The n-gram units are the bytes of the text. Counts of all trusted text are summed in Spark, sharded by
n-gram; continuation counts, discounts, context masses and the interpolated probabilities of every order
are made by joins of those sharded tables. A document's perplexity is the exponential of the mean negative
log probability of its bytes from the ``order``-th on. Few bytes tell little, so the mean is first drawn
towards the language's median as if ``prior_bytes`` more bytes had that perplexity; the document is rejected
if the result lies above a fence that the quantiles of its language's perplexities set.

Defined results
    * null text counts as empty; a document with fewer than ``order`` bytes has a null perplexity and stays
    * a null language is the language ``und``; a null ``doc_id`` is scored like any other row
    * repeated rows are scored one by one and get equal results; ties at a fence stay
    * no trusted text (no labels, an empty table): perplexities are null and every document stays
    * columns of other names, whatever they are, pass through ``quality_filter`` untouched; ``quality_scores``
      returns its own; very long texts are scored whole
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import common, text

ORDER = 5
#: By language, the fence is ``median + UPPER * (q75 - q25)``.
UPPER = 4.0
PRIOR_BYTES = 40
#: Rows of all orders together up to which the model is broadcast; beyond it the documents' n-grams are joined.
MODEL_ROWS = 12_000_000
#: Bins of the histogram of perplexities in a unit of their logarithm.
STEPS = 4_096

_COUNTS = "lang string, gram long, n long"


def _codes(chunk: text.Chunk, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code of the n-gram at each place where one lies within a document, and n-grams before each document."""
    n = len(chunk.data) - order + 1
    sizes = np.maximum(np.diff(chunk.offsets) - order + 1, 0)
    first = np.concatenate([[0], np.cumsum(sizes)])
    if n <= 0:
        return np.empty(0, np.int64), first * 0
    codes = np.zeros(n, np.int64)
    for k in range(order):
        codes <<= 8
        codes |= chunk.data[k : n + k]
    inside = np.ones(n, np.bool_)
    for k in range(1, order):
        cut = chunk.offsets[1:-1] - k
        inside[cut[(cut >= 0) & (cut < n)]] = False
    return codes[inside], first


def _tally(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    at, unique = pd.factorize(codes)
    return unique, np.bincount(at, weights, len(unique)).astype(np.int64)


def _lang_ids(column: pa.Array, names: dict[str, int]) -> np.ndarray:
    return np.array([names.setdefault(x or "und", len(names)) for x in column.to_pylist()], np.int64)


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n): counts of all byte n-grams of ``docs`` (lang, text), combined before the shuffle."""

    def count(batches):
        names: dict[str, int] = {}
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        shift = 8 * order

        def merged():
            codes, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            return _tally(codes, n)

        for batch in batches:
            langs = _lang_ids(batch.column("lang"), names)
            for chunk in text.chunks(batch.column("text")):
                codes, first = _codes(chunk, order)
                codes |= np.repeat(langs[chunk.rows] << shift, np.diff(first))
                parts.append(_tally(codes))
                held += len(parts[-1][0])
                if held > 1_500_000:
                    parts = [merged()]
                    held = len(parts[0][0]) // 2
        if parts:
            codes, n = merged()
            lang = np.array(list(names), object)[codes >> shift] if names else []
            codes &= (1 << shift) - 1
            for at in range(0, len(codes), 100_000):
                to = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(lang[to], pa.string()), pa.array(codes[to]), pa.array(n[to])], names=["lang", "gram", "n"])

    return common.in_python(docs.select("lang", "text"), count, _COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame, order: int) -> DataFrame:
    """(m, kind, lang, gram, p): ``kind`` 'p' has the probability of an observed m-gram, 'g' the mass that an
    observed context of an m-gram leaves to the lower order. Each level is a join of sharded count tables."""
    levels = {order: counts}
    for m in range(order - 1, 0, -1):
        gram = F.col("gram").bitwiseAND((1 << 8 * m) - 1).alias("gram")
        levels[m] = common.written(levels[m + 1].select("lang", gram).groupBy("lang", "gram").agg(F.count("*").alias("n")), f"kn-n{m}")
    lower: DataFrame | None = None
    out: list[DataFrame] = []
    for m in range(1, order + 1):
        level = levels[m]
        kinds = [F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

        def discount(k: int, y=y):
            raw = F.lit(float(k)) - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
            return F.greatest(F.lit(0.1), F.least(F.lit(float(k)), F.coalesce(raw, F.lit(0.5 * k)))).alias(f"d{k}")

        # one row a language
        discounts = level.groupBy("lang").agg(*kinds).select("lang", *(discount(k) for k in (1, 2, 3)))
        n = F.col("n")
        cut = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        cut = F.least(cut, n * 0.9)
        parts = level.join(common.small(discounts), "lang").select("lang", "gram", F.shiftright("gram", 8).alias("context"), n.cast("double").alias("n"), cut.alias("cut"))
        contexts = common.written(parts.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("taken")), f"kn-c{m}")
        grams = parts.join(contexts, ["lang", "context"])
        left = F.col("taken") / F.col("total")
        own = (F.col("n") - F.col("cut")) / F.col("total")
        if lower is None:
            probabilities = grams.select("lang", "gram", (own + left / 256).alias("p"))
        else:
            suffix = F.col("gram").bitwiseAND((1 << 8 * (m - 1)) - 1).alias("suffix")
            below = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q"))
            probabilities = grams.withColumn("suffix", suffix).join(below, ["lang", "suffix"]).select("lang", "gram", (own + left * F.col("q")).alias("p"))
        probabilities = common.written(probabilities, f"kn-{m}")
        lower = probabilities
        out += [probabilities.select(F.lit(m).alias("m"), F.lit("p").alias("kind"), "lang", "gram", "p"), contexts.select(F.lit(m).alias("m"), F.lit("g").alias("kind"), "lang", F.col("context").alias("gram"), left.alias("p"))]
    model = out[0]
    for part in out[1:]:
        model = model.unionByName(part)
    return model


class Model:
    """Probabilities of one or more languages as sorted arrays; scores codes of the highest order."""

    def __init__(self, model: DataFrame, order: int) -> None:
        self.order = order
        self.tables: dict[tuple[str, int, str], tuple[np.ndarray, np.ndarray]] = {}
        number = (F.col("m") * 2 + (F.col("kind") == "g").cast("int")).cast("tinyint").alias("number")
        for (lang,) in model.select("lang").distinct().collect():
            part = model.filter(F.col("lang") == lang).select(number, "gram", "p").toArrow()
            numbers, grams, p = (part.column(c).to_numpy() for c in ("number", "gram", "p"))
            order_ = np.lexsort((grams, numbers))
            numbers, grams, p = numbers[order_], grams[order_], p[order_]
            for k in np.unique(numbers).tolist():
                own = slice(*np.searchsorted(numbers, (k, k + 1)))
                self.tables[lang, k // 2, "pg"[k % 2]] = grams[own], p[own]

    def knows(self, lang: str) -> bool:
        return (lang, 1, "p") in self.tables

    def _find(self, lang: str, m: int, kind: str, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, p = self.tables[lang, m, kind]
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        return keys[at] == codes, p[at]

    def log_p(self, lang: str, codes: np.ndarray) -> np.ndarray:
        p = np.full(len(codes), 1 / 256)
        for m in range(1, self.order + 1):
            code = codes & ((1 << 8 * m) - 1)
            seen, own = self._find(lang, m, "p", code)
            known, left = self._find(lang, m, "g", code >> 8)
            p = np.where(seen, own, np.where(known, left * p, p))
        return np.log(p)


def _score_local(docs: DataFrame, model: DataFrame, order: int) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Model(model, order))
    common.release()

    def score(batches):
        scorer: Model = shared.value
        for batch in batches:
            column = np.array([x or "und" for x in batch.column("lang").to_pylist()], object)
            total, grams = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for chunk in text.chunks(batch.column("text")):
                codes, first = _codes(chunk, order)
                own = column[chunk.rows]
                sizes = np.diff(first)
                for lang in set(own):
                    mine = own == lang
                    some = codes if mine.all() else codes[np.repeat(mine, sizes)]
                    if not len(some) or not scorer.knows(lang):
                        continue
                    at, unique = pd.factorize(some)
                    starts = np.concatenate([[0], np.cumsum(sizes[mine])])
                    rows = np.arange(chunk.rows.start, chunk.rows.stop)[mine]
                    total[rows] = text.document_sums(scorer.log_p(lang, unique)[at], starts)
                    grams[rows] = sizes[mine]
            perplexity = np.exp(-total / np.maximum(grams, 1))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(column, pa.string()), pa.array(grams), pa.array(perplexity, pa.float64(), mask=grams == 0)], names=["key", "doc_id", "lang", "grams", "perplexity"])

    fields = docs.schema
    return common.in_python(docs, score, f"key long, doc_id {fields['doc_id'].dataType.simpleString()}, lang string, grams long, perplexity double")


def _score_joined(docs: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """The same by sharded joins only, for a model too large to broadcast."""
    keyed = docs.select("key", "doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), "text")

    def grams(batches):
        for batch in batches:
            for chunk in text.chunks(batch.column("text")):
                codes, first = _codes(chunk, order)
                row = np.repeat(np.arange(chunk.rows.start, chunk.rows.stop), np.diff(first))
                pairs = pd.DataFrame({"row": row, "gram": codes}).value_counts().reset_index()
                rows = pa.array(pairs["row"])
                yield pa.RecordBatch.from_arrays([batch.column("key").take(rows), batch.column("lang").take(rows), pa.array(pairs["gram"]), pa.array(pairs["count"])], names=["key", "lang", "gram", "n"])

    parts = common.in_python(keyed.select("key", "lang", "text").distinct(), grams, "key long, lang string, gram long, n long")
    needed = parts.select("lang", "gram").distinct().withColumn("p", F.lit(1 / 256))
    for m in range(1, order + 1):
        own = model.filter(f"m = {m} and kind = 'p'").select("lang", F.col("gram").alias("code"), F.col("p").alias("own"))
        left = model.filter(f"m = {m} and kind = 'g'").select("lang", F.col("gram").alias("context"), F.col("p").alias("left"))
        code = F.col("gram").bitwiseAND((1 << 8 * m) - 1)
        needed = needed.withColumn("code", code).withColumn("context", F.shiftright(code, 8)).join(own, ["lang", "code"], "left").join(left, ["lang", "context"], "left").select("lang", "gram", F.coalesce("own", F.col("left") * F.col("p"), "p").alias("p"))
    known = model.filter("m = 1 and kind = 'p'").select("lang").distinct()
    sums = parts.join(needed, ["lang", "gram"]).join(known, "lang").groupBy("key").agg(F.sum("n").alias("grams"), F.exp(-F.sum(F.log("p") * F.col("n")) / F.sum("n")).alias("perplexity"))
    return keyed.select("key", "doc_id", "lang").join(sums, "key", "left").select("key", "doc_id", "lang", F.coalesce("grams", F.lit(0)).alias("grams"), "perplexity")


def fences_of(scores: DataFrame, upper: float) -> DataFrame:
    """(lang, median, fence) from a histogram of the logarithms of perplexities with ``STEPS`` bins a unit.

    Counts are combined before the shuffle and a language has as many bins at most as perplexities of bytes need,
    so no task gets all of a language. A quartile is known to its bin; the edges are taken that make the fence
    higher, so documents at the exact fence stay.
    """
    bins = scores.filter("perplexity is not null").groupBy("lang", F.floor(F.log("perplexity") * STEPS).alias("bin")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("lang")
    cumulated = bins.select("lang", "bin", F.sum("n").over(own.orderBy("bin")).alias("upto"), F.sum("n").over(own).alias("all"))
    low, middle, high = (F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) for q in (0.25, 0.5, 0.75))
    found = cumulated.groupBy("lang").agg(low.alias("low"), middle.alias("middle"), high.alias("high"))
    edge = lambda c, more: F.exp((F.col(c) + more) / STEPS)
    return found.select("lang", edge("middle", 0.5).alias("median"), (edge("middle", 1) + upper * (edge("high", 1) - edge("low", 0))).alias("fence"))


def quality_scores(docs: DataFrame, labels: DataFrame, order: int = ORDER, upper: float = UPPER, prior_bytes: int = PRIOR_BYTES, model_rows: int = MODEL_ROWS) -> DataFrame:
    """(key, doc_id, lang, perplexity, adjusted, fence, keep), one row for each row of ``docs``.

    ``docs`` has doc_id, text and lang; ``labels`` has doc_id and quality. Text of documents whose labels all
    say quality 1 is the trusted text, all of it. ``adjusted`` is the perplexity drawn towards the median.
    """
    source = docs.select(common.row_key("doc_id", "text", "lang").alias("key"), "doc_id", "text", "lang")
    trusted = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q")).filter("q = 1").select("doc_id")
    counts = common.written(gram_counts(source.join(common.small(trusted), "doc_id", "left_semi"), order), "kn-counts")
    # probabilities have one precision, whether the model is broadcast or joined
    model = common.written(kneser_ney(counts, order).withColumn("p", F.col("p").cast("float")), "kn-model")
    scorer = _score_local if model.count() <= model_rows else _score_joined
    scores = common.written(scorer(source, model, order), "quality")
    fences = common.written(fences_of(scores, upper), "fences")
    n = F.col("grams")
    adjusted = F.exp((n * F.log("perplexity") + prior_bytes * F.log("median")) / (n + prior_bytes)).alias("adjusted")
    keep = F.coalesce(F.col("adjusted") <= F.col("fence"), F.lit(True)).alias("keep")
    return scores.join(common.small(fences), "lang", "left").select("key", "doc_id", "lang", "perplexity", adjusted, "fence").select("*", keep)


def quality_filter(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that ``quality_scores`` keeps, with all their columns."""
    rejected = common.written(quality_scores(docs, labels, **options).filter("not keep").select("key", "doc_id").distinct(), "rejected")
    return common.without(docs, rejected, "doc_id", "text", "lang")
