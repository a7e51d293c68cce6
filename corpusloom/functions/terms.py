"""Words, corpus statistics and TF-IDF weights as DataFrame operators.

Logarithms have base 10. ``n`` of a term is its number of occurrences in the corpus (so the inverse
frequency can be negative); ``by="documents"`` counts documents instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.tables import cut, exists, small

#: Terms, the most frequent ones, that ``by_term`` broadcasts.
COMMON = 500_000
#: Words that are counted at once, or those of one text.
WORDS = 1_000_000

WORD = r"[\p{L}\p{N}]+"

STOPWORDS = {
    "en": "the of and to in a is that for it was on with as are at by from this be",
    "de": "der die und das den von zu mit sich des im nicht ein eine auf dem als für ist",
    "fr": "de la le et les des en un une du dans est pour que qui par sur au avec",
    "es": "de la que el en y los del se las por un para con no una su al es",
}


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", fold: bool = True) -> DataFrame:
    """(key, term): one row for each word."""
    column = F.lower(text) if fold else F.col(text)
    return docs.select(key, F.explode(words(column)).alias("term"))


def _pieces(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows that hold at most ``most`` words together, or one row."""
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > most:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _bags(*columns: pa.ListArray) -> tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]:
    """Different words of lists of words, and for each column (row * number of them + word, n), in order."""
    flat = pa.concat_arrays([x.flatten() for x in columns]).dictionary_encode()
    codes, kinds, at, out = flat.indices.to_numpy(zero_copy_only=False), max(1, len(flat.dictionary)), 0, []
    for lists in columns:
        row = np.repeat(np.arange(len(lists)), _sizes(lists))
        out.append(np.unique(row * kinds + codes[at : at + len(row)], return_counts=True))
        at += len(row)
    return flat.dictionary, out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(.., term, n, total, most) of batches (.., words)."""
    for whole in batches:
        for own in _pieces(_sizes(whole.column(whole.num_columns - 1)), WORDS):
            batch = whole.slice(own.start, own.stop - own.start)
            lists, rest = batch.column(batch.num_columns - 1), batch.columns[:-1]
            kinds, [(at, n)] = _bags(lists)
            if not len(at):
                continue
            row, code = np.divmod(at, len(kinds))
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            most = np.repeat(np.maximum.reduceat(n, starts), np.diff(starts, append=len(n)))
            columns = [x.take(pa.array(row)) for x in rest] + [kinds.take(pa.array(code)), pa.array(n), pa.array(_sizes(lists)[row]), pa.array(most)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "term", "n", "total", "most"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, term, n, m) of the words that both lists of batches (a, b, x, y) have; na, nb are the lists' sizes."""
    for whole in batches:
        for own in _pieces(_sizes(whole.column("x")) + _sizes(whole.column("y")), WORDS):
            batch = whole.slice(own.start, own.stop - own.start)
            x, y = batch.column("x"), batch.column("y")
            kinds, [(p, n), (q, m)] = _bags(x, y)
            at, i, j = np.intersect1d(p, q, assume_unique=True, return_indices=True)
            row, code = np.divmod(at, max(1, len(kinds)))
            columns = [batch.column("a").take(pa.array(row)), batch.column("b").take(pa.array(row)), pa.array(_sizes(x)[row]), pa.array(_sizes(y)[row]), kinds.take(pa.array(code)), pa.array(n[i]), pa.array(m[j])]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "na", "nb", "term", "n", "m"])


def _ddl(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def repeated(docs: DataFrame, key: str = "doc_id") -> DataFrame | None:
    """Keys (null is one) of more than one row, none if there are none. Only keys are shuffled."""
    found = cut(docs.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(key).alias("_key")))
    return found if exists(found) else None


def _with_keys(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    return rows.join(small(keys), F.col(key).eqNullSafe(F.col("_key")), how)


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text", fold: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, term, n, total, most): each term of each key, the key's words and its greatest n.

    Texts are counted where they are read, nothing is shuffled but keys. Rows of the same key, if there are any, are counted
    together by word; ``keep`` has columns that are the same in all of them. Keys without words have no rows.
    """
    column = words(F.lower(text) if fold else F.col(text))
    docs = docs.select(key, *keep, text)
    again = repeated(docs, key)
    single = docs if again is None else _with_keys(docs, again, key, "left_anti")
    out = single.select(key, *keep, column.alias("_words")).mapInArrow(_counted, _ddl(docs, key, *keep) + ", term string, n long, total long, most long")
    if again is None:
        return out
    more = _with_keys(docs, again, key, "left_semi").select(key, *keep, F.explode(column).alias("term"))
    some = more.groupBy(key, "term").agg(*(F.first(c).alias(c) for c in keep), F.count("*").alias("n"))
    own_key = Window.partitionBy(key)
    return out.unionByName(some.select(key, *keep, "term", "n", F.sum("n").over(own_key).alias("total"), F.max("n").over(own_key).alias("most")))


def stopword_table(spark) -> DataFrame:
    return spark.createDataFrame([(lang, w) for lang, ws in STOPWORDS.items() for w in ws.split()], "lang string, term string")


def without_stopwords(rows: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Rows (.., lang, term) whose term isn't a stop word of their language; stop words are a fixed list."""
    return rows.join(small(stopwords), ["lang", "term"], "left_anti")


def unless_stopword(rows: DataFrame, stopwords: DataFrame, match: str = "raw") -> DataFrame:
    """Rows (.., lang, term) without stop words, by ``match``: ``raw`` compares terms as they are, ``normalized`` in
    lower case, ``both`` either way."""
    own = stopwords.select(F.col("lang").alias("_lang"), F.col("term").alias("_term")).distinct()
    same = F.col("lang") == F.col("_lang")
    raw, low = F.col("term") == F.col("_term"), F.lower("term") == F.col("_term")
    out = rows
    if match in ("raw", "both"):
        out = out.join(small(own), same & raw, "left_anti")
    if match in ("normalized", "both"):
        out = out.join(small(own), same & low, "left_anti")
    return out


def term_counts(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, n)."""
    return rows.groupBy(key, "term").agg(F.count("*").alias("n"))


TF: dict[str, Callable[[Column, Column, Column], Column]] = {
    "binary": lambda n, total, most: F.lit(1.0),
    "raw": lambda n, total, most: n.cast("double"),
    "freq": lambda n, total, most: n / total,
    "log": lambda n, total, most: F.log10(1 + n),
    "double": lambda n, total, most: 0.5 + 0.5 * n / most,
}

IDF: dict[str, Callable[[Column, Column, Column], Column]] = {
    "unary": lambda n, documents, most: F.lit(1.0),
    "std": lambda n, documents, most: F.log10(documents / n),
    "smooth": lambda n, documents, most: F.log10(documents / (1 + n)) + 1,
    "max": lambda n, documents, most: F.log10(most / (1 + n)),
    "prob": lambda n, documents, most: (documents - n) / n,
}


def term_frequency(counts: DataFrame, kind: str, key: str = "doc_id") -> DataFrame:
    """(key, term, n, tf); rows that don't have the key's ``total`` and ``most`` (of ``counts``) are gathered by key."""
    own = Window.partitionBy(key)
    total, most = (F.col("total"), F.col("most")) if "most" in counts.columns else (F.sum("n").over(own), F.max("n").over(own))
    return counts.select(key, "term", "n", TF[kind](F.col("n"), total, most).alias("tf"))


def inverse_frequency(counts: DataFrame, kind: str, documents: DataFrame, by: str = "terms", key: str = "doc_id") -> DataFrame:
    """(term, df, idf); ``documents`` is one row with the number of documents in ``documents``."""
    n = F.sum("n") if by == "terms" else F.count("*")
    totals = counts.groupBy("term").agg(n.alias("df"))
    most = totals.agg(F.max("df").alias("most")) if kind == "max" else documents.select(F.lit(None).cast("bigint").alias("most"))
    joined = totals.crossJoin(F.broadcast(most)).crossJoin(F.broadcast(documents))
    return joined.select("term", "df", IDF[kind](F.col("df"), F.col("documents"), F.col("most")).alias("idf"))


def by_term(rows: DataFrame, table: DataFrame, how: str = "inner", frequency: str = "df", common: int | None = None, on: str = "term") -> DataFrame:
    """``rows`` joined with ``table`` on term, of which each term has one row (``cut`` it before).

    The most frequent terms, at most ``common`` (COMMON) of them, are broadcast; only rows of other terms are shuffled,
    which are few, as terms of texts are. ``how`` is inner or left.
    """
    common = COMMON if common is None else common
    step = F.floor(F.log2(F.col(frequency).cast("double")) * 8)
    sizes = table.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()
    kept, least = 0, None
    for row in sorted(sizes, key=lambda r: r["step"], reverse=True):
        kept += row["n"]
        if kept > common:
            break
        least = row["step"]
    if kept <= common:
        return rows.join(F.broadcast(table), on, how)
    if least is None:
        return rows.join(table, on, how)
    frequent = F.broadcast(table.filter(step >= least))
    rest = rows.join(frequent.select(on), on, "left_anti")
    return rows.join(frequent, on).unionByName(rest.join(table.filter(step < least), on, how))


def tf_idf(counts: DataFrame, documents: DataFrame, tf: str = "freq", idf: str = "std", key: str = "doc_id", occurrences: DataFrame | None = None) -> DataFrame:
    """(key, term, raw, weight): weights divided by their sum over the document; null where that is 0.

    ``weight`` needs all rows of a document at one place; where only their sum is wanted, ``normalised`` is cheaper.
    ``occurrences`` (term, n) may stand for ``counts`` in the inverse frequency.
    """
    inverse = cut(inverse_frequency(counts if occurrences is None else occurrences, idf, documents, key=key))
    weights = by_term(term_frequency(counts, tf, key), inverse)
    raw = F.col("tf") * F.col("idf")
    total = F.sum(raw).over(Window.partitionBy(key))
    return weights.select(key, "term", raw.alias("raw"), F.try_divide(raw, F.when(F.abs(total) > 1e-12, total)).alias("weight"))


def normalised(vectors: DataFrame, key: str = "doc_id", weight: str = "raw") -> DataFrame:
    """(key, matched, total): number and sum of the weights divided by their sum; 0 and null where that sum is 0.

    Rows are added up before the shuffle: the quotients' sum is that of the weights over itself.
    """
    sums = vectors.groupBy(key).agg(F.sum(weight).alias("s"), F.count(weight).alias("n"))
    some = F.abs("s") > 1e-12
    return sums.select(key, F.when(some, F.col("n")).otherwise(0).alias("matched"), F.when(some, F.col("s") / F.col("s")).alias("total"))


def norms(vectors: DataFrame, key: str = "doc_id", weight: str = "raw") -> DataFrame:
    """(key, norm): Euclidean length of each vector."""
    return vectors.groupBy(key).agg(F.sqrt(F.sum(F.col(weight) * F.col(weight))).alias("norm"))


def _cosines(pairs: DataFrame, dots: DataFrame, lengths: DataFrame) -> DataFrame:
    full = pairs.join(dots, ["a", "b"], "left").join(lengths.toDF("a", "na"), "a", "left").join(lengths.toDF("b", "nb"), "b", "left")
    return full.select("a", "b", F.try_divide(F.coalesce("dot", F.lit(0.0)), F.col("na") * F.col("nb")).alias("cosine"))


def cosine(pairs: DataFrame, vectors: DataFrame, key: str = "doc_id", weight: str = "raw") -> DataFrame:
    """(a, b, cosine) of given pairs of documents by their sparse vectors (key, term, weight)."""
    left = pairs.join(vectors.select(F.col(key).alias("a"), "term", F.col(weight).alias("x")), "a")
    dots = left.join(vectors.select(F.col(key).alias("b"), "term", F.col(weight).alias("y")), ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    return _cosines(pairs, dots, norms(vectors, key, weight))


def text_cosine(pairs: DataFrame, docs: DataFrame, documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, cosine) of given pairs of texts by TF-IDF, as ``cosine`` of ``tf_idf`` with shares of all terms' counts.

    Texts are sent to their pairs whole and compared there; weights go no further than sums by document and by
    pair. Keys of several rows, if there are any, are compared by rows of ``cosine``.
    """
    again = repeated(docs, key)
    inverse = cut(inverse_frequency(tokens(docs, key, text).withColumn("n", F.lit(1)), "std", documents, key=key))
    raw = F.col("tf") * F.col("idf")
    vectors = by_term(term_frequency(counts(docs, key, text), "freq", key), inverse).select(key, "term", raw.alias("raw"))
    lengths = cut(norms(vectors, key))
    odd = None
    if again is not None:
        marks = _with_keys(pairs.select("a").distinct(), again, "a", "left_semi").withColumn("_a", F.lit(True))
        others = _with_keys(pairs.select("b").distinct(), again, "b", "left_semi").withColumn("_b", F.lit(True))
        marked = pairs.join(marks, "a", "left").join(others, "b", "left").withColumn("_odd", F.coalesce("_a", "_b", F.lit(False)))
        odd, pairs = marked.filter("_odd").select("a", "b"), marked.filter("not _odd").select("a", "b")
    own = docs.select(key, text)
    texts = pairs.join(own.toDF("a", "_x"), "a").join(own.toDF("b", "_y"), "b")
    lists = texts.select("a", "b", words(F.lower("_x")).alias("x"), words(F.lower("_y")).alias("y"))
    rows = lists.mapInArrow(_shared, _ddl(pairs, "a", "b") + ", na long, nb long, term string, n long, m long")
    x, y = F.col("n") / F.col("na") * F.col("idf"), F.col("m") / F.col("nb") * F.col("idf")
    dots = by_term(rows, inverse).groupBy("a", "b").agg(F.sum(x * y).alias("dot"))
    out = _cosines(pairs, dots, lengths)
    if odd is None:
        return out
    ends = odd.select("a").union(odd.select("b")).distinct().toDF(key)
    return out.unionByName(cosine(odd, cut(vectors.join(small(ends), key, "left_semi")), key))
