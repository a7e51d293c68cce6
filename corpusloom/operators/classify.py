"""Linear text classification over TF-IDF vectors."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import terms
from corpusloom.functions.tables import cut, small

#: Cells that terms are hashed to; the model's size, whatever the vocabulary.
DIMENSIONS = 1 << 20
#: Terms of documents that are packed into a row, about; most tasks, so gradients, of an evaluation.
BLOCK, TASKS = 250_000, 16


def targets(rows: DataFrame, is_class: Column) -> DataFrame:
    """``rows`` with target 1 for the class and -1 for the rest."""
    return rows.withColumn("target", F.when(is_class, 1.0).otherwise(-1.0))


def _cell(dimensions: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(dimensions)).cast("int")


def minimised(value, start: np.ndarray, tolerance: float, rounds: int) -> tuple[np.ndarray, int]:
    """Minimum of a smooth convex function by L-BFGS; ``value`` gives it and its gradient at a point.

    Ends when the gradient's norm is ``tolerance`` times that at the start, or after ``rounds``.
    """
    x, (f, g) = start, value(start)
    first, pairs = np.linalg.norm(g), deque(maxlen=10)
    for number in range(rounds):
        if np.linalg.norm(g) <= tolerance * first:
            return x, number
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            alphas.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(first, 1.0)
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        step, slope = 1.0, g @ q
        while True:
            new = x - step * q
            f_new, g_new = value(new)
            if f_new <= f - 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        if (new - x) @ (g_new - g) > 1e-12:
            pairs.append((new - x, g_new - g))
        x, f, g = new, f_new, g_new
    return x, rounds


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (target, i, x) of a row a document as rows of about BLOCK terms: the bytes of targets, sizes, cells
    and weights, which are read again without going through lists."""
    for batch in batches:
        sizes = batch.column("i").value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
        part = np.cumsum(sizes, dtype=np.int64) // BLOCK
        for own in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(part)) + 1):
            if len(own):
                some = batch.slice(own[0], len(own))
                i, x = (some.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("i", "x"))
                found = (some.column("target").to_numpy(zero_copy_only=False), sizes[own], i.astype(np.int32), x.astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in found], names=["target", "size", "i", "x"])


def fit_svr(vectors: DataFrame, labelled: DataFrame, key: str = "doc_id", weight: str = "raw", c: float = 10.0, epsilon: float = 0.1, tolerance: float = 3e-4, rounds: int = 200, dimensions: int = DIMENSIONS) -> tuple[DataFrame, float]:
    """(weights (cell, weight), bias) of ``train_svr``: the model by the cells that terms are hashed to (``celled``).

    Documents are packed once, then read by at most TASKS tasks an evaluation; a task sends one gradient, of the
    model's size, so that nothing is shuffled and what the driver gets doesn't grow with the documents.
    """
    spark = vectors.sparkSession
    rows = vectors.join(small(labelled.select(key, "target")), key)
    lists = rows.groupBy(key).agg(F.first("target").alias("target"), F.collect_list(_cell(dimensions)).alias("i"), F.collect_list(F.col(weight).cast("double")).alias("x")).select("target", "i", "x")
    packed = cut(lists.mapInArrow(_packed, "target binary, size binary, i binary, x binary"))
    packed = packed.coalesce(max(1, min(TASKS, spark.sparkContext.defaultParallelism)))

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast(w)

        def gradient(batches):
            own = shared.value
            total, loss, bias = np.zeros(len(own) - 1), 0.0, 0.0
            for batch in batches:
                for target, size, cells, values in zip(*(batch.column(n).to_pylist() for n in ("target", "size", "i", "x")), strict=True):
                    target, size, cells, values = np.frombuffer(target), np.frombuffer(size, np.int32), np.frombuffer(cells, np.int32), np.frombuffer(values)
                    row = np.repeat(np.arange(len(size)), size)
                    error = np.bincount(row, values * own[cells], len(size)) + own[-1] - target
                    slack = np.sign(error) * np.maximum(np.abs(error) - epsilon, 0)
                    loss += float(slack @ slack)
                    bias += float(slack.sum())
                    np.add.at(total, cells, slack[row] * values)
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([bias]), pa.array([total.tobytes()], pa.binary())], names=["loss", "bias", "g"])

        out, loss = w.copy(), 0.0
        for row in packed.mapInArrow(gradient, "loss double, bias double, g binary").toArrow().to_batches():
            for part, bias, g in zip(row.column("loss"), row.column("bias"), row.column("g"), strict=True):
                loss += part.as_py()
                out[-1] += 2 * c * bias.as_py()
                out[:-1] += 2 * c * np.frombuffer(g.as_buffer())
        shared.unpersist()
        return float(w @ w) / 2 + c * loss, out

    w, _ = minimised(value, np.zeros(dimensions + 1), tolerance, rounds)
    some = np.flatnonzero(w[:-1])
    return spark.createDataFrame(pa.table({"cell": pa.array(some.astype(np.int32)), "weight": pa.array(w[some])})), float(w[-1])


def celled(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``vectors`` with the ``cell`` of each term."""
    return vectors.withColumn("cell", _cell(dimensions))


def train_svr(vectors: DataFrame, labelled: DataFrame, key: str = "doc_id", weight: str = "raw", c: float = 10.0, epsilon: float = 0.1, tolerance: float = 3e-4, rounds: int = 200, dimensions: int = DIMENSIONS) -> tuple[DataFrame, float]:
    """(weights (term, weight), bias) of a linear support vector regression, L2-regularised with squared
    epsilon-insensitive loss: the minimum of |w|^2 / 2 + c * sum of losses, bias included in w.

    Rows (key, term, weight) of ``vectors`` are joined with (key, target) of ``labelled`` and written once; every
    evaluation sends the model to the executors and adds up one gradient a task. No term is left out: terms are
    hashed to ``dimensions`` cells, which bounds the model. Training ends by the gradient, not by rounds.
    """
    table, bias = fit_svr(vectors, labelled, key, weight, c, epsilon, tolerance, rounds, dimensions)
    known = celled(vectors.select("term").distinct(), dimensions)
    return known.join(F.broadcast(table), "cell").select("term", "weight"), bias


def predict(vectors: DataFrame, weights: DataFrame, bias: float = 0.0, min_tokens: int = 0, min_terms: int = 0, key: str = "doc_id", weight: str = "tf") -> DataFrame:
    """(key, score): null unless the document has more than ``min_tokens`` tokens and ``min_terms`` known terms.

    Of ``weights`` with a frequency ``df`` (``cut``) the most frequent terms are broadcast; those by ``cell``, of
    ``fit_svr``, are broadcast whole and joined with ``celled`` vectors.
    """
    if "cell" in weights.columns:
        rows = vectors.join(F.broadcast(weights), "cell", "left")
    else:
        rows = terms.by_term(vectors, weights, "left") if "df" in weights.columns else vectors.join(weights, "term", "left")
    joined = rows.groupBy(key).agg(F.sum("n").alias("tokens"), F.count("weight").alias("matched"), F.sum(F.col(weight) * F.col("weight")).alias("s"))
    enough = (F.col("tokens") > min_tokens) & (F.col("matched") > min_terms)
    return joined.select(key, F.when(enough, F.col("s") + bias).alias("score"))


def classifier(spark: SparkSession, mode: str, path: str | None = None, vectors: DataFrame | None = None, labelled: DataFrame | None = None, **options) -> tuple[DataFrame, float]:
    """(weights, bias) by ``mode``: ``load`` reads ``path``; ``train`` trains; ``all`` reads ``path`` if it holds a
    classifier, else trains and saves there. What a mode needs must be given."""
    from corpusloom.operators import store

    needs = {"load": (path,), "train": (vectors, labelled), "all": (path, vectors, labelled)}
    if mode not in needs or any(x is None for x in needs[mode]):
        raise ValueError(f"mode {mode!r} doesn't have what it needs")
    if mode == "all":
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        mode = "load" if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop) else "all"
    if mode == "load":
        return store.load_classifier(spark, path)
    weights, bias = train_svr(vectors, labelled, **options)
    if path is not None:
        store.save_classifier(weights, bias, path)
    return weights, bias
