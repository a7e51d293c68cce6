"""Link extraction, link classes, the web graph and its measures."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import page, urls, weburl


#: Links that are sent on together, those of the last page aside.
CHUNK = 20_000


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of batches (page_id, url, html). Pages are read one by one, and no more than a page and CHUNK links are held."""
    for batch in batches:
        ids, rows = batch.column("page_id"), []
        for at, (url, html) in enumerate(zip(batch.column("url"), batch.column("html"), strict=True)):
            if len(rows) >= CHUNK:
                yield _rows(ids, rows)
                rows = []
            url, html = url.as_py(), html.as_py()
            if html is None:
                continue
            follows, base, found = page.links(html)
            if not follows:
                continue
            here = weburl.resolve(url, base) if base is not None else None
            here = here or url
            if not found:
                found = [("PlainText", u) for u in page.plain_urls(page.text(html))]
            src = weburl.normal(url)
            for method, target in found:
                dst = weburl.resolve(here, target)
                if dst is not None:
                    rows.append((at, None if src is None else src.partition("#")[0], method, dst))
        if rows:
            yield _rows(ids, rows)


def _rows(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    at, *columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *(pa.array(c, pa.string()) for c in columns)], names=["page_id", "src", "method", "dst"])


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, src, method, dst): different links of each page by method, in normal form.

    Pages are read once, in Python, as attribute syntax and the URL standard need it. ``src`` is the page's url
    without fragment. Plain-text urls are looked for only where the other methods find nothing; pages whose robots
    tag forbids to follow links have none; so do targets that aren't urls.
    """

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(_found, f"page_id {kind}, src string, method string, dst string").distinct()


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, src, dst): different hyperlinks of each page, without fragments and self links."""
    found = extracted(pages).filter("method = 'Href'").select("page_id", "src", urls.strip_fragment(F.col("dst")).alias("dst"))
    return found.filter(F.coalesce(F.col("dst") != F.col("src"), F.lit(True))).distinct()


def classified(links: DataFrame) -> DataFrame:
    """Links with ``link_type`` (data, on_seed, outgoing) and the child depth of a parent at depth 0."""
    child = urls.child_depth(urls.depth(0, 0, 0), F.col("src"), F.col("dst"))
    kind = F.when(F.lower("dst").startswith("data:"), "data").when(child["distance_to_seed"] == 0, "on_seed").otherwise("outgoing")
    return links.withColumn("depth", child).withColumn("link_type", kind)


def edges(links: DataFrame) -> DataFrame:
    """(subject, predicate, object): links and origins of all urls, each once."""
    ends = links.select(F.col("src").alias("u")).union(links.select("dst")).distinct()
    origins = ends.select(F.col("u").alias("subject"), F.lit("has_origin").alias("predicate"), urls.origin(F.col("u")).alias("object")).filter("object is not null")
    return links.select(F.col("src").alias("subject"), F.lit("links_to").alias("predicate"), F.col("dst").alias("object")).distinct().unionByName(origins)


PREFIXES = {"": "http://example.org/crawl#", "o": "http://example.org/origin/", "ol": "http://example.org/label/", "rdfs": "http://www.w3.org/2000/01/rdf-schema#"}


def seeds(seeds_: DataFrame) -> DataFrame:
    """Edges (origin, has_seed, url) of seed urls (url) that have an origin."""
    url = F.col("url")
    return seeds_.select(urls.origin(url).alias("subject"), F.lit("has_seed").alias("predicate"), url.alias("object")).filter("subject is not null").distinct()


def turtle(graph: DataFrame, prefixes: bool = False) -> DataFrame:
    """(line): one Turtle statement for each edge, after the prefix declarations if wanted.

    Origins are names in the namespace ``o``; urls are written in angle brackets.
    """
    is_origin = F.col("predicate") == "has_origin"
    from_origin = F.col("predicate") == "has_seed"
    node = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    name = lambda c: F.concat(F.lit("o:"), c)
    subject = F.when(from_origin, name(F.col("subject"))).otherwise(node(F.col("subject")))
    value = F.when(is_origin, name(F.col("object"))).otherwise(node(F.col("object")))
    lines = graph.select(F.concat(subject, F.lit(" :"), "predicate", F.lit(" "), value, F.lit(" .")).alias("line"))
    if not prefixes:
        return lines
    head = graph.sparkSession.createDataFrame([(f"@prefix {k}: <{v}> .",) for k, v in PREFIXES.items()], "line string")
    return head.union(lines)
