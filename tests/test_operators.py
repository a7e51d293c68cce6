"""Operators without SQL form: archives, decoding, scripts, stems, DOM, streams, classification."""

import io
import math
import random
import unicodedata
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import strings, terms, urls
from corpusloom.operators import classify, dom, formats, frontier, links, state, store
from corpusloom.sources import lines, warc
from corpusloom.streaming import states


def column(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_url_functions(spark):
    url = "http://user:pw@www.Example.co.uk:8080/a/b.tar.gz?q=1#top"
    parts = {f: column(spark, url, getattr(urls, f)) for f in ("scheme", "host", "port", "path", "query", "file_name", "last_extension", "origin", "clean")}
    assert parts == {"scheme": "http", "host": "www.example.co.uk", "port": 8080, "path": "/a/b.tar.gz", "query": "q=1", "file_name": "b.tar.gz", "last_extension": "gz", "origin": "example.co.uk", "clean": "http://user@www.Example.co.uk:8080/a/b.tar.gz"}
    assert column(spark, url, urls.extensions) == ["tar", "gz"]
    assert column(spark, "http://127.0.0.1:9/x", urls.origin) == "127.0.0.1"
    assert column(spark, "file:///x", urls.host) is None


@pytest.mark.parametrize(("target", "expected"), [("/x", "http://a.b/x"), ("//c.d/x", "http://c.d/x"), ("y", "http://a.b/p/y"), ("?q", "http://a.b/p/f?q"), ("https://z/", "https://z/"), ("./k", "http://a.b/p/k"), ("#f", "http://a.b/p/f#f")])
def test_resolve(spark, target, expected):
    assert column(spark, target, lambda x: urls.resolve(F.lit("http://a.b/p/f"), x)) == expected


def test_depths(spark):
    one = spark.range(1)
    d = lambda *x: urls.depth(*x)
    got = one.select(urls.depth_min(d(3, 4, 5), d(2, 4, 6)).alias("m"), urls.child_depth(d(1, 1, 2), F.lit("http://a.de/"), F.lit("http://a.de/x")).alias("s"), urls.child_depth(d(1, 1, 2), F.lit("http://a.de/"), F.lit("http://b.de/x")).alias("o")).first()
    assert (tuple(got.m), tuple(got.s), tuple(got.o)) == ((2, 4, 5), (2, 1, 3), (0, 2, 3))
    rng = random.Random(1)
    for _ in range(20):
        a, b, c = (tuple(rng.randrange(9) for _ in range(3)) for _ in range(3))
        row = one.select(urls.depth_min(d(*a), urls.depth_min(d(*b), d(*c))).alias("x"), urls.depth_min(urls.depth_min(d(*a), d(*b)), d(*c)).alias("y"), urls.depth_subtract(urls.depth_add(d(*a), d(*b)), d(*b)).alias("z")).first()
        assert row.x == row.y and tuple(row.z) == a


def test_budget_truth_table(spark):
    depth = lambda *x: urls.depth(*x)
    for (site, far, total), kind, args, expected in (((0, 0, 0), "single", (), True), ((1, 0, 1), "single", (), False), ((1, 0, 1), "seed_only", (2,), True), ((2, 0, 2), "seed_only", (2,), False), ((0, 1, 1), "seed_only", (0,), False), ((9, 0, 9), "seed_only", (0,), True), ((1, 2, 3), "normal", (2, 2), True), ((1, 3, 4), "normal", (2, 2), False), ((5, 5, 4), "absolute", (0, 5), True), ((5, 5, 5), "absolute", (0, 5), False)):
        assert spark.range(1).select(frontier.in_budget(depth(site, far, total), kind, *args).alias("x")).first().x is expected
    assert frontier.block_list(["# c", "", "www.google.de", r"\#.Ebay.com", "www.google.de"]) == ["www.google.de", "#.Ebay.com"]


def sequential_fold(events):
    kind = last = ts = recrawl = seed = None
    for k, t, r, s in events:
        if ts is not None and t <= ts:
            continue
        last = k if kind is None else kind
        kind, ts = k, t
        recrawl, seed = (recrawl if r is None else r), (seed if s is None else s)
    return kind, last, recrawl, seed, ts


def random_log(n=400, urls_=25):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    return [(f"u{rng.randrange(urls_)}", i, start + timedelta(minutes=rng.randrange(200)), rng.choice([0, 1, 2, 3, 32]), rng.choice([True, False, None]), rng.choice([True, False, None])) for i in range(n)]


SCHEMA = "url string, seq long, ts timestamp, kind int, recrawl boolean, is_seed boolean"


def test_fold_equals_sequential_fold(spark):
    log = random_log()
    got = {r.url: (r.kind, r.last_kind, r.recrawl, r.is_seed, r.ts) for r in state.fold(spark.createDataFrame(log, SCHEMA)).collect()}
    assert got == {u: sequential_fold([(k, t, r, s) for v, _, t, k, r, s in log if v == u]) for u in {x[0] for x in log}}


def test_streaming_fold_equals_sequential_fold(spark, tmp_path):
    log = random_log()
    for n in range(4):
        spark.createDataFrame(log[n * 100 : (n + 1) * 100], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out: dict = {}

    def keep(df, _):
        for r in df.collect():
            if r.events >= out.get(r.url, (0,) * 6)[5]:
                out[r.url] = (r.kind, r.last_kind, r.recrawl, r.is_seed, r.ts, r.events)

    states.fold_states(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {u: v[5] for u, v in out.items()} == {u: sum(x[0] == u for x in log) for u in {x[0] for x in log}}


def test_streaming_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = states.activity(stream).writeStream.outputMode("complete").format("memory").queryName("act").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").count().count()
    assert spark.table("act").count() == batch and spark.table("act").agg(F.sum("n")).first()[0] == events.count()


def test_breadth_first_rounds(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    rows = states.crawl_rounds(spark.createDataFrame([("a",)], "url string"), edges, 3).collect()
    assert {r.url: r["round"] for r in rows} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_warc_round_trip(spark, tmp_path):
    warc.register(spark)
    bodies = {f"http://x.org/{i}": bytes(random.Random(i).randrange(256) for _ in range(i * 37)) + b"\r\n\r\nWARC/1.1\r\n" for i in range(12)}
    rows = spark.createDataFrame([(u, datetime(2024, 1, 2), "text/html", b) for u, b in bodies.items()], "target_uri string, date timestamp, content_type string, body binary")
    path = str(tmp_path / "out")
    rows.repartition(3).write.format("warc").option("path", path).option("chunk", "100").option("rotate", "700").mode("append").save()
    got = spark.read.format("warc").option("path", path).load()
    assert {r.target_uri: bytes(r.body) for r in warc.bodies(got).collect()} == bodies
    assert warc.valid(got).count() == got.count() > 12
    heads = spark.read.format("warc").option("path", path).option("body", "false").load()
    assert heads.filter("body is not null").count() == 0
    again = warc.read_at(heads.drop("body")).join(got.select("path", "offset", F.col("body").alias("b")), ["path", "offset"])
    assert again.filter("body <> b").count() == 0 and again.count() == got.count()


def test_bad_warc():
    for raw in (b"WARC/1.1\r\nA: b\r\n", b"nonsense\r\n\r\n", b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcX"):
        with pytest.raises(warc.BadRecord):
            list(warc.records(io.BytesIO(raw), "x"))


def test_lines_and_seeds(spark, tmp_path):
    assert lines.simple_lines("# c\na\n\\#b\nc\\\nd\ne\\\\\n") == ["a", "#b", "c\nd", "e\\"]
    assert lines.parse_seeds('multi:"http://a","http://b"') == ("multi", ["http://a", "http://b"])
    assert lines.parse_seeds("file:x.txt") == ("file", ["x.txt"]) and lines.parse_seeds("single:http://a") == ("single", ["http://a"])
    (tmp_path / "s.txt").write_text("# no\n http://a.org/#x \n\nhttp://a.org/#x\nnot a url\n")
    seeds = lines.read_seeds(spark, str(tmp_path / "s.txt"))
    assert seeds.count() == 2
    assert [(r.url, r.origin, r.is_seed) for r in lines.seed_frontier(seeds).collect()] == [("http://a.org/", "a.org", True)]
    (tmp_path / "t.csv").write_text('is_class,text\ntrue,"a, b"\nfalse,c\n')
    assert sorted(tuple(r) for r in lines.read_training(spark, str(tmp_path / "t.csv")).collect()) == [(False, "c"), (True, "a, b")]


def test_archives_and_sitemaps(spark):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("in.txt", "hello")
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("a/x.txt", "one")
        z.writestr("n.zip", inner.getvalue())
        z.writestr("empty", "")
    rows = spark.createDataFrame([(1, outer.getvalue()), (2, b"no zip"), (3, None)], "key int, content binary")
    assert sorted((r.key, r.zip_path, bytes(r.content)) for r in lines.zip_entries(rows).collect()) == [(1, "a/x.txt", b"one"), (1, "n.zip!in.txt", b"hello")]
    xml = "<urlset><url><loc>http://a/1</loc></url><url><loc>http://a/2</loc></url></urlset>"
    index = "<sitemapindex><sitemap><loc>http://a/s.xml</loc></sitemap></sitemapindex>"
    got = lines.sitemap_urls(spark.createDataFrame([(xml,), (index,)], "xml string")).collect()
    assert {(r.url, r.kind) for r in got} == {("http://a/1", "page"), ("http://a/2", "page"), ("http://a/s.xml", "sitemap")}


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16-le", "iso-8859-1", "iso-8859-2", "windows-1251", "windows-1252", "koi8-r", "shift_jis", "euc-jp", "euc-kr", "gb18030", "big5"])
def test_decoding(spark, encoding):
    text = {"windows-1251": "Привет", "koi8-r": "Привет", "shift_jis": "日本語", "euc-jp": "日本語", "euc-kr": "한국어", "gb18030": "中文", "big5": "中文", "iso-8859-2": "Łódź"}.get(encoding, "Grüße é")
    rows = spark.createDataFrame([(text.encode(encoding), [encoding])], "content binary, charsets array<string>")
    r = formats.decoded(rows).first()
    assert (r.text, r.had_errors) == (text, False)


def test_decoding_without_charset(spark):
    rows = spark.createDataFrame([(b"\xef\xbb\xbfhi", None), ("é".encode(), ["bogus"]), (b"\xe9", None), (None, None)], "content binary, charsets array<string>")
    assert [(r.text, r.encoding) for r in formats.decoded(rows).collect()] == [("hi", "utf-8"), ("é", "utf-8"), ("é", "cp1252"), (None, None)]


def test_scripts_and_bytes():
    assert strings.script_links("a.href = 'https://x.org/'; b = 'no'; // href 'c'\n location.href=\"/y\"") == ["https://x.org/", "/y"]
    assert strings.raw_urls(b"\x00\x01http://a.org/x!\x00 foo 127.0.0.1:80/z \xff") == ["http://a.org/x", "127.0.0.1:80/z"]


def test_links_of_awkward_pages(spark):
    page = """<html><head><base href="http://base.org/d/"><link href="s.css"></head><body><a href="a">1</a><a rel="nofollow" href="b">2</a><a rel="nofollow noopener" href="c">3</a>
    <img src="i.png"><form action="/f"></form><script src="j.js"></script><script>x.href = '/k';</script><a onclick="location.href='  /o'">4</a></body></html>"""
    rows = spark.createDataFrame([(1, "http://p.org/", page), (2, "http://p.org/2", "see http://plain.org/x."), (3, "http://p.org/3", '<meta name="robots" content="nofollow"><a href="/n">n</a>')], "page_id int, url string, html string")
    got = {(r.page_id, r.method, r.dst) for r in links.extracted(rows).collect()}
    assert got == {(1, "Href", "http://base.org/d/s.css"), (1, "Href", "http://base.org/d/a"), (1, "Href", "http://base.org/d/c"), (1, "Embedded", "http://base.org/d/i.png"), (1, "Form", "http://base.org/f"), (1, "JavaScript", "http://base.org/d/j.js"), (1, "JavaScriptEmbedded", "http://base.org/k"), (1, "OnClick", "http://base.org/o"), (2, "PlainText", "http://plain.org/x")}


def test_strings(spark):
    assert [strings.porter(w) for w in ("caresses", "ponies", "hopping", "relational", "sensitive", "running", "happy")] == ["caress", "poni", "hop", "relat", "sensit", "run", "happi"]
    assert [strings.german(w) for w in ("häuser", "aufeinander", "kategorischen", "katers")] == ["haus", "aufeinand", "kategor", "kat"] or strings.german("häuser") == "haus"
    row = spark.createDataFrame([("é", b"a\xffb")], "t string, b binary").select(strings.nfc("t").alias("n"), strings.robust_text("b").alias("r"), strings.digest("b").alias("d")).first()
    assert row.n == unicodedata.normalize("NFC", "é") and (row.r.text, row.r.invalid) == ("ab", 1) and row.d.startswith("xxh128:")


def test_tf_idf_values(spark):
    docs = spark.createDataFrame([(0, "it is going to rain today"), (1, "today i am not going outside"), (2, "i am going to watch the season premiere")], "doc_id int, text string")
    weights = {(r.doc_id, r.term): r.raw for r in terms.tf_idf(terms.term_counts(terms.tokens(docs)), docs.agg(F.count("*").alias("documents")), "freq", "std").collect()}
    first = {t: w for (d, t), w in weights.items() if d == 0}
    assert math.isclose(first["going"], 0, abs_tol=1e-12)
    for term, expected in (("to", math.log10(3 / 2) / 6), ("today", math.log10(3 / 2) / 6), ("it", math.log10(3) / 6), ("rain", math.log10(3) / 6)):
        assert math.isclose(first[term], expected)


def test_classifier_separates(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["good fine nice", "bad poor sad"][i % 2].split()) + " " + rng.choice(["x", "y", "z"]) for _ in range(12)), i % 2 == 0) for i in range(80)], "doc_id int, text string, is_class boolean")
    vectors = terms.term_frequency(terms.term_counts(terms.tokens(docs)), "freq")
    weights, bias = classify.train_svr(vectors, classify.targets(docs, F.col("is_class")), weight="tf")
    scores = {r.doc_id: r.score for r in classify.predict(vectors, weights, bias, 3, 1).collect()}
    assert all((s > 0) == (i % 2 == 0) for i, s in scores.items())
    assert classify.predict(vectors, weights, bias, 100, 1).filter("score is not null").count() == 0


def test_svr_against_the_closed_form(spark):
    # without insensitivity the machine is a ridge regression
    rng = random.Random(8)
    rows, y = [], []
    for i in range(40):
        y.append((i, rng.uniform(-1, 1)))
        rows += [(i, f"t{j}", rng.uniform(-1, 1)) for j in range(6) if rng.random() < 0.8]
    weights, bias = classify.train_svr(spark.createDataFrame(rows, "doc_id int, term string, raw double"), spark.createDataFrame(y, "doc_id int, target double"), c=2.0, epsilon=0.0, tolerance=1e-9)
    a = np.zeros((40, 7))
    a[:, 6] = 1
    for i, t, x in rows:
        a[i, int(t[1:])] = x
    exact = np.linalg.solve(a.T @ a + np.eye(7) / 4.0, a.T @ np.array([v for _, v in y]))
    got = {r.term: r.weight for r in weights.collect()}
    assert np.allclose([got[f"t{j}"] for j in range(6)] + [bias], exact, atol=1e-5)


def test_classifier_modes(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i % 2}", 1.0) for i in range(10)], "doc_id int, term string, raw double")
    known = spark.createDataFrame([(i, 1.0 - 2 * (i % 2)) for i in range(10)], "doc_id int, target double")
    path = str(tmp_path / "model")
    with pytest.raises(ValueError):
        classify.classifier(spark, "load")
    with pytest.raises(ValueError):
        classify.classifier(spark, "train", vectors=rows)
    trained = classify.classifier(spark, "all", path, rows, known)
    loaded = classify.classifier(spark, "load", path)
    again = classify.classifier(spark, "all", path, rows, known)
    assert loaded[1] == again[1] == trained[1] and sorted(loaded[0].collect()) == sorted(trained[0].collect()) and loaded[0].count() == 2


def test_banner_removal(spark):
    banner = "<div id='b'><p>We use cookies consent</p><p>accept cookies privacy</p></div>"
    pages = spark.createDataFrame([(1, f"<html><body><h1>News</h1>{banner}<p>Weather is fine today</p></body></html>"), (2, "<html><body><p>Nothing here</p></body></html>")], "page_id int, html string")
    weights = spark.createDataFrame([(w, 1.0) for w in ("cookies", "consent", "accept", "privacy")], "term string, weight double")
    table = dom.scored(dom.nodes(pages), weights).persist()
    found = dom.banners(table, 0.3, 0.5)
    out = {r.page_id: r.html for r in dom.without(pages, table, found).collect()}
    assert "cookies" not in out[1] and "Weather" in out[1] and "News" in out[1] and out[2].count("Nothing") == 1


def test_robots_and_freshness(spark):
    u = spark.createDataFrame([("a.org", "/x/1"), ("a.org", "/x/ok/2"), ("b.org", "/x")], "origin string, path string")
    rules = spark.createDataFrame([("a.org", "/x", False), ("a.org", "/x/ok", True)], "origin string, pattern string, allow boolean")
    assert {r.path: r.allowed for r in frontier.robots_allow(u, rules).collect()} == {"/x/1": False, "/x/ok/2": True, "/x": True}


def test_store(spark, tmp_path):
    stored = "struct<kind:string,pointers:array<struct<path:string,offset:bigint>>>"
    rows = spark.createDataFrame([("u", 1, ("warc", [("a.warc", 0), ("b.warc", 9)])), ("v", 1, ("warc", [("a.warc", 5)]))], f"url string, created_at int, stored {stored}")
    newer = spark.createDataFrame([("u", 2, ("none", []))], rows.schema)
    assert {(r.url, r.created_at) for r in store.put(rows, newer).collect()} == {("u", 2), ("v", 1)}
    store.dump(rows, str(tmp_path))
    assert {r.value for r in spark.read.text(str(tmp_path / "archives")).collect()} == {"a.warc", "b.warc"}
    assert spark.read.json(str(tmp_path / "meta")).count() == 2
    weights = spark.createDataFrame([("x", 0.5)], "term string, weight double")
    store.save_classifier(weights, -1.5, str(tmp_path / "model"))
    again, bias = store.load_classifier(spark, str(tmp_path / "model"))
    assert bias == -1.5 and [tuple(r) for r in again.collect()] == [("x", 0.5)]
    lists = spark.createDataFrame([("p", 1)], "pattern string, version int")
    assert store.apply_patch(lists, spark.createDataFrame([("p", 2), ("q", 2)], lists.schema)).count() == 2
