"""Pages as node tables, and removal of banner subtrees by a text classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import markup, terms
from corpusloom.functions.tables import cut, small

#: Characters of elements, about, that are sent on together.
CHUNK = 2_000_000
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Nodes(HTMLParser):
    """Rows (node, parent, tag, places, start, end) of elements; ``places`` are where the element's text, its own and
    its descendants', begins and ends in ``text``, which all of them share."""

    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=True)
        self.starts = [0]
        for line in source.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.rows: list[list] = []
        self.stack: list[int] = []
        self.parts: list[str] = []
        self.size = 0
        self.feed(source)
        self.close()
        for node in self.stack:
            self.rows[node][5] = len(source)
            self.rows[node][3][1] = self.size
        self.text = "".join(self.parts)

    def text_of(self, node: int) -> str:
        start, end = self.rows[node][3]
        return self.text[start:end]

    def _at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def handle_starttag(self, tag: str, attrs) -> None:
        self.rows.append([len(self.rows), self.stack[-1] if self.stack else None, tag, [self.size, self.size], self._at(), self._at() + len(self.get_starttag_text() or "")])
        if tag not in _VOID:
            self.stack.append(len(self.rows) - 1)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.rows[self.stack.pop()][3][1] = self.size

    def handle_endtag(self, tag: str) -> None:
        open_tags = [self.rows[n][2] for n in self.stack]
        if tag in open_tags:
            end = self._at() + len(tag) + 3
            while self.stack:
                node = self.stack.pop()
                self.rows[node][3][1] = self.size
                self.rows[node][5] = end if self.rows[node][2] == tag else self._at()
                if self.rows[node][2] == tag:
                    break

    def handle_data(self, data: str) -> None:
        if self.stack and self.rows[self.stack[-1]][2] not in ("script", "style"):
            self.parts.append(data)
            self.size += len(data)


def _flattened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements of batches (page_id, html), in batches of about CHUNK characters."""
    for batch in batches:
        ids, rows, size = batch.column("page_id"), [], 0
        for at, source in enumerate(batch.column("html")):
            page = _Nodes(html) if (html := source.as_py()) else None
            for node in page.rows if page else ():
                rows.append((at, *node[:3], text := page.text_of(node[0]), *node[4:]))
                size += 100 + len(text)
                if size > CHUNK:
                    yield _rows(ids, rows)
                    rows, size = [], 0
        if rows:
            yield _rows(ids, rows)


def _rows(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    at, *columns = zip(*rows, strict=True)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *map(pa.array, columns, kinds)], names=["page_id", "node", "parent", "tag", "text", "start", "end"])


def nodes(pages: DataFrame) -> DataFrame:
    """(page_id, node, parent, tag, text, start, end) of every element of ``pages`` (page_id, html).

    Pages are parsed one by one and their elements sent on as they are found, so that no more than a page and about
    CHUNK characters are held.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInArrow(_flattened, f"page_id {kind}, node long, parent long, tag string, text string, start long, end long")


def _tags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, tags, counts = [], [], []
        for i, source in enumerate(batch.column("html")):
            own = Counter(row[2] for row in _Nodes(html).rows) if (html := source.as_py()) else {}
            at += [i] * len(own)
            tags += own.keys()
            counts += own.values()
        yield pa.RecordBatch.from_arrays([batch.column("page_id").take(pa.array(at, pa.int64())), pa.array(tags, pa.string()), pa.array(counts, pa.int64())], names=["page_id", "tag", "n"])


def tags(pages: DataFrame) -> DataFrame:
    """(page_id, tag, n): elements of each tag; pages are counted where they are read, without their text."""
    kind = pages.schema["page_id"].dataType.simpleString()
    found = pages.select("page_id", "html").mapInArrow(_tags, f"page_id {kind}, tag string, n long")
    return found.groupBy("page_id", "tag").agg(F.sum("n").alias("n"))


def scored(table: DataFrame, weights: DataFrame) -> DataFrame:
    """``table`` with the sum of the weights of its text's words over their number; null without words."""
    words = table.select("page_id", "node", F.explode(terms.words(F.lower("text"))).alias("term"))
    sums = words.join(small(weights), "term", "left").groupBy("page_id", "node").agg((F.sum(F.coalesce("weight", F.lit(0.0))) / F.count("*")).alias("score"))
    return table.join(sums, ["page_id", "node"], "left")


def may_be_banner(tag: Column) -> Column:
    """Tags whose text may be that of a banner: some containers, and all but programs and containers otherwise."""
    kind = markup.category(tag)
    return tag.isin("p", "a", "div", "title", "dialog", "details") | ~kind.isin("programming", "style")


def leaves(table: DataFrame) -> DataFrame:
    """Nodes without children whose parent isn't a program or a container (there text says little by itself)."""
    parents = table.filter("parent is not null").select("page_id", F.col("parent").alias("node")).distinct()
    above = table.select("page_id", F.col("node").alias("parent"), markup.category(F.col("tag")).alias("_kind"))
    found = table.join(parents, ["page_id", "node"], "left_anti").join(above, ["page_id", "parent"], "left")
    return found.filter(F.coalesce(~F.col("_kind").isin("programming", "style"), F.lit(True))).select(*table.columns)


def banners(table: DataFrame, threshold: float, keep: float, by_tag: bool = False) -> DataFrame:
    """(page_id, node): the banner of each page that has one.

    From the leaves that score ``threshold`` the pages' survivors climb to their parents, level by level, while
    a page has more than one and a parent still scores ``threshold``; the best of the last level is the banner
    if it scores ``keep``. ``table`` has page_id, node, parent, score, and tag with ``by_tag``, which lets only leaves
    of ``leaves`` start and only parents of ``may_be_banner`` be climbed to. Every round climbs a level of the tree.
    """
    if by_tag:
        start, table = leaves(table), table.filter(may_be_banner(F.col("tag")))
    else:
        parents = table.filter("parent is not null").select("page_id", "parent").distinct().withColumnRenamed("parent", "node")
        start = table.join(parents, ["page_id", "node"], "left_anti")
    level = cut(start.filter(F.col("score") >= threshold).select("page_id", "node", "parent", "score"))
    while True:
        if not level.groupBy("page_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
            break
        alone = F.count("*").over(Window.partitionBy("page_id"))
        marked = level.withColumn("_n", alone)
        up = marked.filter("_n > 1 and parent is not null").select("page_id", F.col("parent").alias("node")).distinct()
        climbed = up.join(table.select("page_id", "node", "parent", "score"), ["page_id", "node"]).filter(F.col("score") >= threshold)
        done = marked.filter("_n = 1").drop("_n")
        stuck = marked.filter("_n > 1").drop("_n").join(climbed.select("page_id").distinct(), "page_id", "left_anti")
        if climbed.isEmpty():
            break
        level = cut(climbed.select("page_id", "node", "parent", "score").unionByName(done).unionByName(stuck))
    best = level.groupBy("page_id").agg(F.max(F.struct("score", -F.col("node"))).alias("b"))
    return best.filter(F.col("b.score") >= keep).select("page_id", (-F.col("b")["col2"]).alias("node"))


def without(pages: DataFrame, table: DataFrame, found: DataFrame) -> DataFrame:
    """``pages`` with the found subtrees cut out of html."""
    cuts = found.join(table.select("page_id", "node", "start", "end"), ["page_id", "node"]).select("page_id", "start", "end")
    joined = pages.join(cuts, "page_id", "left")
    rest = F.concat(F.substring("html", F.lit(1), F.col("start").cast("int")), F.expr("substring(html, cast(end as int) + 1)"))
    return joined.withColumn("html", F.coalesce(rest, F.col("html"))).drop("start", "end")


def tag_text(html: str, tag: str) -> list[str]:
    """Texts of all elements of a tag (for tests and single pages)."""
    page = _Nodes(html)
    return [re.sub(r"\s+", " ", page.text_of(r[0])).strip() for r in page.rows if r[2] == tag]
