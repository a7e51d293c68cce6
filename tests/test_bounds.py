"""What keeps queries within memory and disk as tables grow: see FINDINGS_r03.md for the numbers."""

import re

import duckdb
import pytest
from oracle import compare
from pyspark.sql import functions as F

from corpusloom.functions import terms
from corpusloom.plans import texts
from corpusloom.plans.registry import ORACLES, QUERIES

DOCS = [(1, "en", "a b b c it"), (2, "en", "b c c d"), (2, "en", "d e e"), (None, "de", "x y"), (None, "de", "y z"), (3, "en", ""), (4, "en", None), (5, "de", "b x x q " * 4), (6, "de", "a b c x q")]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def odd_docs(spark):
    return spark.createDataFrame(DOCS, "doc_id int, lang string, text string")


@pytest.fixture
def odd_con():
    con = duckdb.connect()
    con.execute("create table documents (doc_id int, lang varchar, text varchar)")
    con.executemany("insert into documents values (?, ?, ?)", DOCS)
    return con


@pytest.mark.parametrize("kind", ["binary", "raw", "freq", "log", "double"])
def test_term_counts_stay_where_the_text_is(spark, sf_dir, kind):
    # no partition, aggregate or window of words by document
    found = plan(QUERIES[f"tf_{kind}"](spark, sf_dir))
    assert not re.search("Repartition|Aggregate|Window|Join", found), found


@pytest.mark.parametrize("kind", ["unary", "std", "smooth", "max", "prob"])
def test_inverse_frequencies_dont_count_by_document(spark, sf_dir, kind):
    # Words are added up by term only
    found = plan(QUERIES[f"idf_{kind}"](spark, sf_dir))
    assert not re.search(r"Repartition|Aggregate \[doc_id", found), found


@pytest.mark.parametrize("name", [*(f"tf_{k}" for k in ("binary", "raw", "freq", "log", "double")), *(f"idf_{k}" for k in ("std", "max", "prob")), "tfidf_weights", "tfidf_top_terms"])
def test_repeated_and_null_keys_count_together(odd_docs, odd_con, monkeypatch, name):
    monkeypatch.setattr(terms, "COMMON", 3)
    kind = name.partition("_")[2]
    if name.startswith("tf_"):
        got = terms.term_frequency(terms.counts(odd_docs), kind).select("doc_id", "term", F.round("tf", 9).alias("tf"))
    elif name.startswith("idf_"):
        got = terms.inverse_frequency(texts._occurrences(odd_docs), kind, texts._n(odd_docs)).select("term", "df", F.round("idf", 9).alias("idf"))
    else:
        got = getattr(texts, name)(odd_docs)
    assert compare(got, odd_con, ORACLES[name]) is None


def test_cosines_of_repeated_keys(odd_docs, odd_con, monkeypatch):
    # F5
    monkeypatch.setattr(terms, "COMMON", 3)
    docs, sql = odd_docs.filter("doc_id is not null"), ORACLES["doc_cosine"]
    odd_con.execute("delete from documents where doc_id is null")
    assert compare(texts.doc_cosine(docs), odd_con, sql) is None


@pytest.mark.parametrize("name", ["tfidf_weights", "tfidf_normalised", "tfidf_top_terms", "classifier_score", "doc_cosine"])
def test_only_rare_terms_are_shuffled_by_term(spark, sf_dir, monkeypatch, name):
    # With more terms than are broadcast the frequent ones still are
    from oracle import connect

    monkeypatch.setattr(terms, "COMMON", 500)
    got = QUERIES[name](spark, sf_dir)
    found = plan(got)
    assert "LeftAnti" in found and "strategy=broadcast" in found and "RepartitionByExpression" not in found
    assert compare(got, connect(sf_dir), ORACLES[name]) is None


def test_join_by_term_keeps_unknown_terms(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "zz")], "k int, term string")
    table = spark.createDataFrame([("a", 100, 1.0), ("b", 10, 2.0), ("c", 1, 3.0)], "term string, df int, weight double")
    for common in (0, 1, 2, 3):
        assert sorted((r.k, r.weight) for r in terms.by_term(rows, table, "left", common=common).collect()) == [(1, 1.0), (2, 2.0), (3, 3.0), (4, None)]
        assert sorted((r.k, r.weight) for r in terms.by_term(rows, table, common=common).collect()) == [(1, 1.0), (2, 2.0), (3, 3.0)]


def test_pieces_hold_all_rows():
    import numpy as np

    for most in (1, 3, 10):
        cut = list(terms._pieces(np.array([2, 0, 5, 1, 1, 0, 9]), most))
        assert [i for s in cut for i in range(s.start, s.stop)] == list(range(7))
        assert all(s.stop - s.start == 1 or sum([2, 0, 5, 1, 1, 0, 9][s]) <= most for s in cut)


def html_batch(pages, **more):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"page_id": list(range(len(pages))), **more, "html": pages})


def test_elements_are_sent_on_in_pieces(monkeypatch):
    # a batch of pages makes batches of bounded size, whatever the depth of the text
    from corpusloom.operators import dom

    monkeypatch.setattr(dom, "CHUNK", 5_000)
    pages = ["<div>" * 30 + "word " * 20 + "</div>" * 30, None, "", "<p>a<script>b</script>c</p>d<br/>"] * 5
    out = list(dom._flattened([html_batch(pages)]))
    assert len(out) > 5 and max(b.num_rows for b in out) < 60
    rows = [r for b in out for r in b.to_pylist()]
    assert len(rows) == 5 * 33 and [r["text"] for r in rows if r["tag"] == "p"] == ["ac"] * 5 and {len(r["text"]) for r in rows if r["tag"] == "div"} == {100}
    counted = {(r["page_id"], r["tag"]): r["n"] for b in dom._tags([html_batch(pages)]) for r in b.to_pylist()}
    assert counted[0, "div"] == 30 and counted[3, "br"] == 1 and sum(counted.values()) == len(rows)


def test_tags_need_no_text_and_repeated_pages_count_together(spark):
    # F2
    from corpusloom.plans.extras import dom_nodes

    rows = dom_nodes(spark.createDataFrame([(1, "<p>a</p>"), (1, "<p>b</p><i>"), (2, None)], "page_id int, html string"))
    assert sorted(map(tuple, rows.collect())) == [(1, "i", 1), (1, "p", 2)] and "text" not in plan(rows)


def test_links_are_sent_on_in_pieces(monkeypatch):
    # F19, F20, F21
    from corpusloom.operators import links

    monkeypatch.setattr(links, "CHUNK", 10)
    pages = ["".join(f"<a href='/{i}'>" for i in range(7)), None, "see http://x.org/y now"] * 6
    out = list(links._found([html_batch(pages, url=["http://h.org/"] * 18)]))
    assert len(out) > 3 and max(b.num_rows for b in out) < 20 and sum(b.num_rows for b in out) == 6 * 8


def test_training_reads_blocks_and_sends_one_gradient_a_task(spark, monkeypatch):
    # F1
    import numpy as np
    import pyarrow as pa

    from corpusloom.operators import classify

    monkeypatch.setattr(classify, "BLOCK", 4)
    batch = pa.RecordBatch.from_pydict({"target": [1.0, -1.0, 1.0, -1.0], "i": [[1, 2, 3], [4, 5], [], [6]], "x": [[0.1, 0.2, 0.3], [0.4, 0.5], [], [0.6]]})
    out = [r for b in classify._packed([batch]) for r in b.to_pylist()]
    read = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in out]).tolist()
    assert len(out) == 2 and read("size", np.int32) == [3, 2, 0, 1] and read("i", np.int32) == [1, 2, 3, 4, 5, 6]
    assert read("target", float) == [1.0, -1.0, 1.0, -1.0] and read("x", float) == [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]
