"""Queries over fixed inputs whose expected results are written out: odd urls, markup, rules, archives, codes.

The tables at hand have plain urls and markup only; here the expected rows follow from the public standards and are
independent of the operators' code.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import languages, markup, page, urls
from corpusloom.operators import dom, formats, frontier, links, order, scrape, store
from corpusloom.plans.registry import query
from corpusloom.sources import lines


def _sql(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int | float):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def expected(columns: str, rows: list[tuple]) -> str:
    """SQL of a table of literals; ``columns`` are names with types."""
    names = [c.rsplit(" ", 1) for c in columns.split(", ")]
    casts = ", ".join(f"{n}::{t} as {n}" for n, t in names)
    return f"select {casts} from (values {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) t({', '.join(n for n, _ in names)})"


URLS = [
    ("HTTP://B.org:80/%7Ea", "http://b.org/%7Ea"), ("https://example.org:443", "https://example.org/"), ("http://a.org:8080/x/./y/../z", "http://a.org:8080/x/z"),
    ("http://a.org/x/%2e%2E/y", "http://a.org/y"), ("http://user:pw@h.de/p", "http://user:pw@h.de/p"), ("http://a.org/ä b?q=ü c#é", "http://a.org/%C3%A4%20b?q=%C3%BC%20c#%C3%A9"),
    ("http:\\\\a.org\\b", "http://a.org/b"), ("  http://a.org/\tx\n", "http://a.org/x"), ("http://bücher.example/", "http://xn--bcher-kva.example/"), ("http://0x7f.1/", "http://127.0.0.1/"),
    ("http://256.256.256.256/", None), ("http://[0:0::1]/", "http://[::1]/"), ("http://", None), ("http://a b/", None), ("http://a.org:99999/", None), ("relative/path", None),
    ("mailto:x@y.z", "mailto:x@y.z"), ("data:text/plain,Hi", "data:text/plain,Hi"), ("file:///etc/../x", "file:///x"), ("http://a.org?x='1'", "http://a.org/?x=%271%27"), (None, None),
]


@query("url_parse_cases", "region", expected("n int, url varchar, normal varchar", [(i, *u) for i, u in enumerate(URLS)]))
def url_parse_cases(region: DataFrame) -> DataFrame:
    rows = region.sparkSession.createDataFrame([(i, u) for i, (u, _) in enumerate(URLS)], "n int, url string")
    return rows.select("n", "url", urls.normal("url").alias("normal"))


#: The examples of RFC 3986, section 5.4, but for those that browsers resolve otherwise, and some of the URL standard.
BASE = "http://a/b/c/d;p?q"
RESOLVED = [
    ("g:h", "g:h"), ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g/"), ("?y", "http://a/b/c/d;p?y"),
    ("g?y", "http://a/b/c/g?y"), ("#s", "http://a/b/c/d;p?q#s"), ("g#s", "http://a/b/c/g#s"), ("g?y#s", "http://a/b/c/g?y#s"), (";x", "http://a/b/c/;x"), ("g;x", "http://a/b/c/g;x"),
    ("", "http://a/b/c/d;p?q"), (".", "http://a/b/c/"), ("./", "http://a/b/c/"), ("..", "http://a/b/"), ("../", "http://a/b/"), ("../g", "http://a/b/g"), ("../..", "http://a/"),
    ("../../", "http://a/"), ("../../g", "http://a/g"), ("../../../g", "http://a/g"), ("/./g", "http://a/g"), ("/../g", "http://a/g"), ("g.", "http://a/b/c/g."), (".g", "http://a/b/c/.g"),
    ("g..", "http://a/b/c/g.."), ("..g", "http://a/b/c/..g"), ("./../g", "http://a/b/g"), ("./g/.", "http://a/b/c/g/"), ("g/./h", "http://a/b/c/g/h"), ("g/../h", "http://a/b/c/h"),
    ("g;x=1/./y", "http://a/b/c/g;x=1/y"), ("g?y/../x", "http://a/b/c/g?y/../x"), ("g#s/../x", "http://a/b/c/g#s/../x"), ("http:g", "http://a/b/c/g"), ("\\x\\y", "http://a/x/y"), (" g ", "http://a/b/c/g"),
]


@query("url_resolve_cases", "region", expected("target varchar, url varchar", RESOLVED))
def url_resolve_cases(region: DataFrame) -> DataFrame:
    rows = region.sparkSession.createDataFrame([(t,) for t, _ in RESOLVED], "target string")
    return rows.select("target", urls.resolve(F.lit(BASE), "target").alias("url"))


DOMAINS = [("www.example.com", "example.com"), ("a.b.example.co.uk", "example.co.uk"), ("co.uk", None), ("com", None), ("b.test.ck", "b.test.ck"), ("test.ck", None), ("www.ck", "www.ck"), ("a.www.ck", "www.ck"), ("x.y.github.io", "y.github.io"), ("127.0.0.1", None), ("[::1]", None), ("a.b.kobe.jp", "a.b.kobe.jp"), ("city.kobe.jp", "city.kobe.jp"), ("a.unlistedtld", "a.unlistedtld"), ("localhost", None)]


@query("registrable_domains", "region", expected("host varchar, domain varchar", DOMAINS))
def registrable_domains(region: DataFrame) -> DataFrame:
    rows = region.sparkSession.createDataFrame([(h,) for h, _ in DOMAINS], "host string")
    return rows.select("host", urls.domain(F.col("host")).alias("domain"))


PAGES = [
    (1, "http://p.org/d/", "<a href='/single'>1</a><A HREF=/bare>2</A><a href=\"q?a=1&amp;b=2\">3</a><a rel=nofollow href=no>4</a><a rel='nofollow noopener' href=yes>5</a><link href=../up/s.css>"),
    (2, "http://p.org/", "<base target=_top href='http://base.org/x/'><base href=/no><a href=y>1</a><!-- <a href=c> --><script>var s = '<a href=n>'; e.href = 'https://js.org/1'; f = 'no'</script>"),
    (3, "http://p.org/", "<meta content=nofollow name=description><a href=/x>x</a>"),
    (4, "http://p.org/", "<meta name='robots' content='nofollow'><a href=/x>x</a>"),
    (5, "http://p.org/", "<img src=i.png><video src='v.mp4'></video><iframe src=\"f.html\"><a href=in></a></iframe><form method=post action=/send></form><script src=s.js></script>"),
    (6, "http://p.org/", "<div onclick=\"x(); location . href = ' /go ' ;\">g</div><p title='a>b' onclick='no()'><a title=\">\" href=t>t</a>"),
    (7, "http://p.org/", "see http://plain.org/a, and ftp://f.org/b. but not www.c.org"),
    (8, "http://p.org/", "<a href='http://p.org/#top'>self</a><a href='javascript:void(0)'>j</a><a href='http://bad host/'>b</a>"),
    (9, "http://p.org/", None), (10, "http://p.org/", ""), (11, "http://p.org/", "<base href='http://'><a href=z>z</a>"),
]
PAGE_LINKS = [
    (1, "Href", "http://p.org/single"), (1, "Href", "http://p.org/bare"), (1, "Href", "http://p.org/d/q?a=1&b=2"), (1, "Href", "http://p.org/d/yes"), (1, "Href", "http://p.org/up/s.css"),
    (2, "Href", "http://base.org/x/y"), (2, "JavaScriptEmbedded", "https://js.org/1"), (3, "Href", "http://p.org/x"),
    (5, "Embedded", "http://p.org/i.png"), (5, "Embedded", "http://p.org/v.mp4"), (5, "Embedded", "http://p.org/f.html"), (5, "Form", "http://p.org/send"), (5, "JavaScript", "http://p.org/s.js"),
    (6, "OnClick", "http://p.org/go"), (6, "Href", "http://p.org/t"), (7, "PlainText", "http://plain.org/a"), (7, "PlainText", "ftp://f.org/b"),
    (8, "Href", "http://p.org/#top"), (8, "Href", "javascript:void(0)"), (11, "Href", "http://p.org/z"),
]


@query("link_markup_cases", "region", expected("page_id int, method varchar, dst varchar", PAGE_LINKS))
def link_markup_cases(region: DataFrame) -> DataFrame:
    pages = region.sparkSession.createDataFrame(PAGES, "page_id int, url string, html string")
    return links.extracted(pages).select("page_id", "method", "dst")


RULES = [("a", "/private", False), ("a", "/private/open", True), ("a", "/*.pdf$", False), ("a", "/q*x", False), ("a", "/same", True), ("a", "/same", False), ("a", "", False), ("b", "/", False), ("b", "/$", True), ("c", "/a+b(c", False)]
PATHS = [("a", "/private/x", False), ("a", "/private/open/x", True), ("a", "/x/f.pdf", False), ("a", "/x/f.pdf?v", True), ("a", "/qqqx1", False), ("a", "/same/1", True), ("a", "/", True), ("b", "/", True), ("b", "/x", False), ("c", "/a+b(c)", False), ("c", "/aab", True), ("d", "/x", False), ("e", "/private", True)]


@query("robots_cases", "region", expected("origin varchar, path varchar, allowed boolean", PATHS))
def robots_cases(region: DataFrame) -> DataFrame:
    spark = region.sparkSession
    rules = spark.createDataFrame(RULES, "origin string, pattern string, allow boolean")
    at = spark.createDataFrame([p[:2] for p in PATHS], "origin string, path string")
    return frontier.robots_allow(at, rules, spark.createDataFrame([("d",)], "origin string")).select("origin", "path", "allowed")


TYPES = [('Text/HTML; charset="utf-8"; a="x;y=\\"z"', "text", "html", 'a=x;y="z|charset=utf-8'), ("image/svg+xml", "image", "svg+xml", ""), ("application/json ;V=1;b=2", "application", "json", "b=2|v=1")]


@query("media_type_cases", "region", expected("value varchar, type varchar, subtype varchar, parameters varchar", TYPES))
def media_type_cases(region: DataFrame) -> DataFrame:
    rows = region.sparkSession.createDataFrame([(v[0],) for v in TYPES], "value string")
    return rows.select("value", store.media_type(F.col("value")).alias("m")).select("value", "m.type", "m.subtype", F.array_join("m.parameters", "|").alias("parameters"))


BEST = [(1, "text/css", "image/png", "HTML", "text/css"), (2, None, "image/png", "HTML", "image/png"), (3, None, None, "SVG", "image/svg+xml"), (4, None, None, "Unknown", "application/octet-stream")]


@query("best_media_types", "region", expected("n int, best varchar", [(r[0], r[4]) for r in BEST]))
def best_media_types(region: DataFrame) -> DataFrame:
    rows = region.sparkSession.createDataFrame([r[:4] for r in BEST], "n int, mime string, detected string, format string")
    return rows.select("n", store.best_media_type(F.array_compact(F.array("mime")), F.col("detected"), F.col("format")).alias("best"))


HOPS = [("c1", 1, "http://a.de/", "http://a.de/x"), ("c1", 2, "http://a.de/", "http://b.de/"), ("c1", 3, "http://a.de/", "http://c.de/"), ("c2", 1, "http://a.de/", "http://www.a.de/"), ("c3", 1, "http://a.de/", "http://x.de/"), ("c3", 2, "http://a.de/", "http://a.de/y")] + [("c4", i, "http://a.de/", f"http://a.de/{i}") for i in range(1, 13)]
CHAINS = [("c1", 2, "http://b.de/", "stopped"), ("c2", 1, "http://www.a.de/", "final"), ("c3", 2, "http://a.de/y", "final"), ("c4", 10, "http://a.de/10", "too many")]


@query("redirect_chains", "region", expected("chain varchar, hops int, url varchar, outcome varchar", CHAINS))
def redirect_chains(region: DataFrame) -> DataFrame:
    hops = region.sparkSession.createDataFrame(HOPS, "chain string, hop int, source string, url string")
    return store.followed(hops, policies=("host", "subdomain"))


BUDGETS = [(None, 2, 1), ("a.de", None, 3), ("b.de", None, None), ("c.de", 1, None)]
QUEUE = [("a.de", 2, 0, 2, True), ("a.de", 3, 0, 3, False), ("b.de", 0, 0, 0, True), ("b.de", 1, 0, 1, False), ("c.de", 0, 0, 0, True), ("c.de", 0, 1, 1, False), ("d.de", 1, 1, 2, True), ("d.de", 2, 0, 2, False), ("d.de", 0, 2, 2, False)]


@query("origin_budgets", "region", expected("origin varchar, site int, far int, total int, in_budget boolean", QUEUE))
def origin_budgets(region: DataFrame) -> DataFrame:
    spark = region.sparkSession
    budgets = spark.createDataFrame(BUDGETS, "origin string, depth_on_website int, depth int")
    queue = spark.createDataFrame([q[:4] for q in QUEUE], "origin string, site int, far int, total int").withColumn("depth", urls.depth(F.col("site"), F.col("far"), F.col("total")))
    return frontier.with_budgets(queue, budgets).select("origin", "site", "far", "total", "in_budget")


GUARDED = [("a.de", 1, 1, 1, True), ("a.de", 2, 0, 0, False), ("a.de", 1, 1, 2, False), ("b.de", 9, 9, 9, True), (None, 0, 0, 0, False)]


@query("guard_depths", "region", expected("origin varchar, site int, far int, total int, adds_value boolean", GUARDED))
def guard_depths(region: DataFrame) -> DataFrame:
    spark = region.sparkSession
    depth = urls.depth(F.col("site"), F.col("far"), F.col("total"))
    guards = spark.createDataFrame([("a.de", 1, 1, 2), ("a.de", 3, 0, 0)], "origin string, site int, far int, total int").select("origin", depth.alias("depth"))
    queue = spark.createDataFrame([g[:4] for g in GUARDED], "origin string, site int, far int, total int").withColumn("depth", depth)
    return frontier.adds_value(queue, guards).select("origin", "site", "far", "total", "adds_value")


HEURISTIC = [("<!DOCTYPE html><p>", True), (" <!DOCTYPE html><p>", False), ("<html><p>", True), (" <html>", False), ("x<!DOCTYPE html><html>", True), ("<html></html>", True), ("</html><html>", False), ("<!doctype html>", False), ("text", False), ("</html>", False)]


@query("html_heuristic_cases", "region", expected("text varchar, is_html boolean", HEURISTIC))
def html_heuristic_cases(region: DataFrame) -> DataFrame:
    rows = region.sparkSession.createDataFrame([(t,) for t, _ in HEURISTIC], "text string")
    return rows.select("text", markup.looks_like_html(F.col("text")).alias("is_html"))


CODES = [("de", "deu", "German"), ("DEU", "deu", "German"), ("english", "eng", "English"), ("zh", "cmn", "Mandarin"), ("fa", "fas", "Persian"), ("xx", None, None), (None, None, None)]


@query("language_codes", "region", expected("lang varchar, code varchar, name varchar", CODES))
def language_codes(region: DataFrame) -> DataFrame:
    rows = region.sparkSession.createDataFrame([(c[0],) for c in CODES], "lang string")
    return rows.select("lang", languages.code(F.col("lang")).alias("code"), languages.name(F.col("lang")).alias("name"))


def _archive(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, content in members.items():
            archive.writestr(zipfile.ZipInfo(name), content)
    return out.getvalue()


_RELS = b'<?xml version="1.0"?><Relationships xmlns="r"><Relationship Id="1" Target="http://office.org/a" TargetMode="External"/><Relationship Id="2" Target="media/i.png"/></Relationships>'
_ODF = b'<?xml version="1.0"?><office:text xmlns:office="o" xmlns:xlink="x"><a xlink:href="http://odf.org/a"/><b xlink:href="Pictures/1.png"/></office:text>'
DOCUMENTS = [
    (1, "http://d.org/a.xml", None, b'<?xml version="1.0"?><r xmlns:x="u"><a x:href="/b">see http://text.org/x.</a><i src="c.png"/></r>'),
    (2, "http://d.org/b.svg", None, b'<?xml version="1.0"?><svg xmlns:xlink="u"><a xlink:href="http://svg.org/1"/><use href="#part"/></svg>'),
    (3, "http://d.org/c.rtf", None, b'{\\rtf1 {\\field{\\*\\fldinst{HYPERLINK "http://rtf.org/"}}{\\fldrslt x}}}'),
    (4, "http://d.org/d.docx", None, _archive({"word/_rels/document.xml.rels": _RELS})),
    (5, "http://d.org/e.odt", None, _archive({"content.xml": _ODF})),
    (6, "http://d.org/f.zip", None, _archive({"in/page.html": b"<html><a href='http://zip.org/1'></a><a href='/no'></a></html>", "empty.txt": b"", "more.jar": _archive({"notes.txt": b"at http://jar.org/2."})})),
    (7, "http://d.org/g", None, b"\x00\x01\xfe http://raw.org/x \x00"),
    (8, "http://d.org/h.zip", None, b"PK\x03\x04 broken"),
    (9, "http://d.org/i.js", None, b"a.href = '/from/js';"),
    (10, "http://d.org/j.txt", None, None),
]
FOUND = [
    (1, None, "XmlAttribute", "http://d.org/b"), (1, None, "XmlAttribute", "http://d.org/c.png"), (1, None, "XmlText", "http://text.org/x"), (2, None, "Svg", "http://svg.org/1"), (2, None, "Svg", "http://d.org/b.svg#part"), (3, None, "Rtf", "http://rtf.org/"),
    (4, None, "Ooxml", "http://office.org/a"), (5, None, "Odf", "http://odf.org/a"), (6, "in/page.html", "Href", "http://zip.org/1"), (6, "more.jar!notes.txt", "PlainText", "http://jar.org/2"), (7, None, "Raw", "http://raw.org/x"), (9, None, "JavaScript", "http://d.org/from/js"),
]


@query("document_links", "region", expected("key int, zip_path varchar, method varchar, dst varchar", FOUND))
def document_links(region: DataFrame) -> DataFrame:
    return scrape.document_links(region.sparkSession.createDataFrame(DOCUMENTS, "key int, url string, format string, content binary"))


def _encrypted() -> bytes:
    """An archive whose member is marked as encrypted."""
    raw = bytearray(_archive({"secret.txt": b"http://no.org/"}))
    raw[6] |= 1
    raw[raw.index(b"PK\x01\x02") + 8] |= 1
    return bytes(raw)


ENTRIES = [("a", "x.txt", 1, "hello", None), ("a", "n.zip!y.txt", 2, "deep", None), ("a", "big.bin", 1, None, "too large"), ("b", "secret.txt", 1, None, "encrypted"), ("c", "", 0, None, "not an archive")]


@query("archive_members", "region", expected("key varchar, zip_path varchar, depth int, text varchar, problem varchar", ENTRIES))
def archive_members(region: DataFrame) -> DataFrame:
    files = [("a", _archive({"x.txt": b"hello", "dir/": b"", "n.zip": _archive({"y.txt": b"deep"}), "big.bin": b"0" * 200})), ("b", _encrypted()), ("c", b"nothing")]
    rows = region.sparkSession.createDataFrame(files, "key string, content binary")
    return lines.zip_entries(rows, max_bytes=150).select("key", "zip_path", "depth", F.decode("content", "utf-8").alias("text"), "problem")


SEEDS = [("HTTP://A.de/x#y", "http://a.de/x", None), ("no url", None, "not a url"), ("", None, "blank"), ("mailto:x@y.z", None, "no origin")]


@query("seed_rejects", "region", expected("url varchar, reason varchar", [("no url", "not a url"), ("", "blank"), ("mailto:x@y.z", "no origin"), ("http://a.de/x", "kept")]))
def seed_rejects(region: DataFrame) -> DataFrame:
    """Seeds that are kept, in normal form, and those that aren't with the reason."""
    seeds = region.sparkSession.createDataFrame([(s[0],) for s in SEEDS], "url string")
    return lines.rejected_seeds(seeds).union(lines.seed_frontier(seeds).select("url", F.lit("kept")))


BANNERS = "<html><body><div><p>a text that says nothing</p></div><div><p>accept all cookies now</p><p>cookies consent</p></div><script>cookies consent cookies</script><p>more</p></body></html>"


@query("banner_candidates", "region", expected("tag varchar, leaf boolean, may_be boolean", [("body", False, True), ("div", False, True), ("div", False, True), ("html", False, True), ("p", False, True), ("p", False, True), ("p", False, True), ("p", True, True), ("script", True, False)]))
def banner_candidates(region: DataFrame) -> DataFrame:
    """Which nodes of a page may start a banner and which may hold one."""
    table = dom.nodes(region.sparkSession.createDataFrame([(1, BANNERS)], "page_id int, html string"))
    starts = dom.leaves(table).select("page_id", "node", F.lit(True).alias("leaf"))
    return table.join(starts, ["page_id", "node"], "left").select("tag", F.coalesce("leaf", F.lit(False)).alias("leaf"), dom.may_be_banner(F.col("tag")).alias("may_be"))


@query("row_numbers", "orders", "select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as seq from orders")
def row_numbers(orders: DataFrame) -> DataFrame:
    """Numbers in a total order, by ranges."""
    return order.numbered(orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "seq")


RECORDS = [("http://a.de/", None, 200, b"abc", "http://a.de/", "http://a.de/", 3), ("http://a.de/old", "http://a.de/new", 301, None, "http://a.de/new", "http://a.de/old", None)]


@query("response_records", "region", expected("url varchar, requested varchar, status int, content_length bigint", [(r[4], r[5], r[2], r[6]) for r in RECORDS]))
def response_records(region: DataFrame) -> DataFrame:
    rows = region.sparkSession.createDataFrame([r[:4] for r in RECORDS], "url string, final_url string, status int, body binary")
    return store.response_records(rows).drop("body")


SCRIPTS = [(1, "a.href = 'x'; b = 'y'; c.href = \"z\"", "x|z"), (2, "// href 'no'\nhref = `t`;", "t"), (3, "href; 'late'", "")]


@query("script_link_cases", "region", expected("n int, links varchar", [(n, x) for n, _, x in SCRIPTS]))
def script_link_cases(region: DataFrame) -> DataFrame:
    from corpusloom.functions import strings

    rows = region.sparkSession.createDataFrame([s[:2] for s in SCRIPTS], "n int, source string")
    return rows.select("n", F.array_join(strings.links_of_script("source"), "|").alias("links"))


TAGS = [("a", {"href": "x", "title": ">"}), ("img", {"src": "i", "alt": ""})]


@query("attribute_cases", "region", expected("tag varchar, name varchar, value varchar", [(t, k, v) for t, own in TAGS for k, v in own.items()]))
def attribute_cases(region: DataFrame) -> DataFrame:
    rows = [(t, k, v) for t, own, _ in page.tags("<!-- <b> --><a HREF = 'x' href=no title=\">\"></a><img src=i alt>") for k, v in own.items()]
    return region.sparkSession.createDataFrame(rows, "tag string, name string, value string")


@query("format_methods", "region", expected("format varchar, methods varchar", [("HTML", "html,raw"), ("OOXML", "ooxml"), ("Unknown", "raw"), ("ZIP", "zip")]))
def format_methods(region: DataFrame) -> DataFrame:
    rows = region.sparkSession.createDataFrame([("HTML",), ("ZIP",), ("OOXML",), ("Unknown",)], "format string")
    found = formats.extractors(rows).groupBy("format").agg(F.array_sort(F.collect_list(F.struct("priority", "method"))).alias("m"))
    return found.select("format", F.array_join(F.transform("m", lambda x: x["method"]), ",").alias("methods"))
