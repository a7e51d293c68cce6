"""Every operator and stage over awkward rows: nulls, empty and very long texts, repeats, clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import bpe, decontamination, edits, html, language, quality, secrets, simhash, substrings, toxicity

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node string, rank int, label string, toxic string, hash string"


@pytest.fixture(scope="module")
def awkward(spark):
    some = "the quick brown fox jumps over the lazy dog and runs far away from the noisy town " * 4
    rows = [
        (1, some, "en"), (1, some, "en"), (2, some, "en"), (3, None, "en"), (4, "", None), (None, some + "again", "en"),
        (None, None, None), (5, " \n\t ", "fr"), (6, "###", "de"), (7, LONG, "en"), (8, "é" * 50_000, "fr"), (9, "x", "en"),
        (10, 'password = "hunter2" and token: 9f8e7d6c5b4a39281706f5e4d3c2b1a0', "en"), (11, "日本語のテキスト 🙂 " * 20, "ja"), (12, "\u0000� nul", "en"),
    ]
    return spark.createDataFrame([(i, t, lang, None, None, "k", "n", 1, "l", "t", "h") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (7, 1, None), (None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark_items(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs far"), (2, None), (3, ""), (3, "x"), (None, "zebras never lie about striped umbrellas in spring rain")], "item_id long, text string")


def operators(labels, benchmark_items):
    pages = lambda d: d.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h.example/"), "doc_id").alias("url"), F.col("text").alias("html"), "key", "node")
    return {
        "secrets": secrets.credential_values,
        "redact": secrets.redact,
        "simhash": simhash.near_duplicates,
        "simhash_filter": simhash.near_duplicate_filter,
        "substrings": substrings.repeated_passages,
        "edits": edits.fingerprints,
        "language": language.identify,
        "decontamination": lambda d: decontamination.contaminated(d, benchmark_items),
        "decontaminate": lambda d: decontamination.decontaminate(d, benchmark_items),
        "html": lambda d: html.extract(pages(d)),
        "bpe": bpe.encode,
        "toxicity": lambda d: toxicity.toxic_passages(d, labels),
        "quality": lambda d: quality.quality_scores(d, labels),
        "quality_filter": lambda d: quality.quality_filter(d, labels),
    }


EACH_ROW = {"redact", "edits", "language", "bpe", "toxicity", "quality", "html"}
NAMES = sorted(operators(None, None))


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(name, awkward, labels, benchmark_items):
    rows = operators(labels, benchmark_items)[name](awkward).collect()
    if name in EACH_ROW:
        assert len(rows) == awkward.count()
    if name in ("redact", "simhash_filter", "decontaminate", "quality_filter"):
        assert set(rows[0].asDict()) == set(awkward.columns)
    if name == "secrets":
        assert sorted((r.doc_id, r.context, r.is_secret) for r in rows) == [(10, "password", False), (10, "token", True)]
    if name == "redact":
        (text,) = [r.text for r in rows if r.doc_id == 10]
        assert "hunter2" in text and "9f8e" not in text and "[REDACTED]" in text
    if name == "simhash_filter":
        ids = [r.doc_id for r in rows]
        assert ids.count(1) == 1 and 2 not in ids and {3, 4, 5, 6, 7, 8, 9, 11, 12} <= set(ids)
    if name == "decontamination":
        assert {r.doc_id for r in rows} == {1, 2, 9, None}
    if name == "bpe":
        assert all(r.round_trip for r in rows)
        assert [r.tokens for r in rows if r.doc_id == 3] == [None] and [r.tokens for r in rows if r.doc_id == 4] == [[]]
    if name == "quality":
        assert all(r.keep for r in rows if r.perplexity is None)
    if name == "edits":
        assert {r.group_id for r in rows if r.doc_id in (1, 2)} == {1}
        assert {r.group_id for r in rows if r.doc_id in (3, 4)} == {None}


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(name, awkward, labels, benchmark_items):
    none = awkward.limit(0)
    assert operators(labels.limit(0), benchmark_items.limit(0))[name](none).collect() == []


def test_no_labels_reject_nothing(awkward, labels):
    assert quality.quality_filter(awkward, labels.limit(0)).count() == awkward.count()
    assert not [r for r in toxicity.toxic_passages(awkward, labels.limit(0)).collect() if r.is_toxic]


def test_stages_keep_the_columns_of_documents(spark, sf_dir, awkward, tmp_path):
    docs = awkward
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == awkward.columns
            assert [f.dataType for f in out.schema] == [f.dataType for f in awkward.schema]
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
    assert docs.count()
    assert corpus_pipeline.STAGES[0][1](spark, awkward.limit(0), sf_dir).count() == 0


@pytest.mark.parametrize("name", ["redact", "simhash_filter", "decontaminate", "quality_filter"])
def test_stages_with_clashing_columns(spark, name, labels, benchmark_items):
    some = "the quick brown fox jumps over the lazy dog and runs far away from the noisy town " * 4
    docs = spark.createDataFrame([(1, some, "en"), (1, some, "en"), (2, "words that nobody else has, at least not here", "en"), (3, None, "en")], "doc_id long, text string, lang string")
    names = "_key _KEY_ _drop _again _bad _rejected _wanted _id _node _own _mark key node list band word group label toxic share rows keep".split()
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    out = operators(labels, benchmark_items)[name](docs)
    rows = out.collect()
    assert out.columns == docs.columns and all(r[n] == n for r in rows for n in names)
    expected = {"redact": [1, 1, 2, 3], "simhash_filter": [1, 2, 3], "decontaminate": [2, 3], "quality_filter": [1, 1, 2, 3]}
    assert sorted(r.doc_id for r in rows) == expected[name]
