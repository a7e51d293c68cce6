"""HTML extraction (operator 7): site templates are removed by counting element subtrees per host.

Each page is parsed into elements, and every element's subtree gets a Merkle hash of its tag, attributes,
text and children (comments, scripts and styles don't count). Spark counts on how many pages of a host each
subtree occurs. Subtrees on at least ``PAGES`` pages and ``SHARE`` of the pages of their host are template;
they are cut out, and the text of what is left is the page's content.

Defined results
    * null or empty html gives an empty text; a page without a host (null or relative url) has no template
    * one row for each row of ``pages``; equal rows count as one page of their host
    * unclosed elements end where their parent ends; stray end tags are ignored
    * only block elements (nav, div, p, li, ...) are cut, so sentences keep their links and emphasis; the roots
      (html, head, body) are never template themselves
    * very long or deep pages are parsed whole, in time that grows with their length; an empty table gives an
      empty result; columns of other names aren't read; ties don't arise
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common

PAGES, SHARE = 3, 0.01
#: Template subtrees up to which they are broadcast; beyond, each page is joined with its own.
TEMPLATES = 2_000_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S | re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead title tr ul body head html".split())
_CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
#: Block starts that end an open paragraph.
_PARAGRAPH = _BLOCK - {"br", "body", "head", "html", "title"}
_ROOTS = frozenset(("html", "head", "body"))
_CUT = _BLOCK - _ROOTS
_SPACE = re.compile(r"\s+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def host_of(url: str | None) -> str | None:
    found = _HOST.match(url or "")
    return found[1].lower() if found else None


class Element:
    __slots__ = ("children", "hash", "tag")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag = tag
        self.children: list[Element | str] = []
        self.hash = xxhash.xxh3_64(f"<{tag} {attributes}>".encode("utf-8", "replace"))

    def seal(self) -> None:
        """Turn the running digest into the subtree's hash."""
        self.hash = self.hash.intdigest()


def parse(source: str) -> Element:
    """Tree of the page; text is kept with single spaces."""
    root = Element("")
    stack = [root]
    # depth of the nearest block at each depth, and how many elements of each tag are open
    block, opened = [0], Counter()

    def close() -> None:
        done = stack.pop()
        block.pop()
        opened[done.tag] -= 1
        done.seal()
        stack[-1].hash.update(done.hash.to_bytes(8, "little"))

    for m in _TOKEN.finditer(source):
        tag = m[3]
        if tag is None:
            piece = m[0]
            if piece[0] == "<" and len(piece) > 1:
                continue
            piece = _SPACE.sub(" ", piece)
            if piece != " ":
                stack[-1].children.append(piece)
                stack[-1].hash.update(piece.encode("utf-8", "replace"))
            continue
        tag = tag.lower()
        if m[2]:
            if opened[tag]:
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        closes = _CLOSES.get(tag)
        if closes and stack[-1].tag in closes:
            close()
        elif tag in _PARAGRAPH:
            depth = block[-1]
            if stack[depth].tag == "p":
                while len(stack) > depth:
                    close()
        attributes = m[4]
        element = Element(tag, _SPACE.sub(" ", attributes).strip(" /"))
        stack[-1].children.append(element)
        if tag in _VOID or attributes.endswith("/"):
            element.seal()
            stack[-1].hash.update(element.hash.to_bytes(8, "little"))
        else:
            block.append(len(stack) if tag in _BLOCK else block[-1])
            stack.append(element)
            opened[tag] += 1
    while len(stack) > 1:
        close()
    root.seal()
    return root


def _key(element: Element, host: str) -> int:
    """Signed 64-bit key of a subtree at a host."""
    value = xxhash.xxh3_64_intdigest(f"{element.hash}@{host}".encode())
    return value - (1 << 64) if value >> 63 else value


def subtrees(root: Element, host: str) -> set[int]:
    """Keys of all block subtrees with text or children, but the roots."""
    out, stack = set(), [root]
    while stack:
        for child in stack.pop().children:
            if isinstance(child, Element):
                if child.children:
                    stack.append(child)
                    if child.tag in _CUT:
                        out.add(_key(child, host))
    return out


def content(root: Element, host: str | None, template) -> tuple[str, int]:
    """Text without template subtrees, one block a line, and how many subtrees went."""
    lines: list[str] = []
    words: list[str] = []
    gone = 0

    def flush() -> None:
        line = _SPACE.sub(" ", entities.unescape("".join(words))).strip()
        words.clear()
        if line:
            lines.append(line)

    stack: list[Element | str | None] = list(reversed(root.children))
    while stack:
        node = stack.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            words.append(node)
        elif node.tag == "head":
            continue
        elif host and template and node.children and node.tag in _CUT and _key(node, host) in template:
            gone += 1
            flush()
        else:
            if node.tag in _BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(node.children))
    flush()
    return "\n".join(lines), gone


def _found(pages: DataFrame) -> DataFrame:
    """(key, host, subtrees) of each different page that has a host."""

    def hashes(batches):
        for batch in batches:
            rows, hosts, found = [], [], []
            for i, (url, source) in enumerate(zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)):
                host = host_of(url)
                if host and source:
                    rows.append(i)
                    hosts.append(host)
                    found.append(np.fromiter(sorted(subtrees(parse(source), host)), np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            flat = np.concatenate(found) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows, pa.int64())), pa.array(hosts, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "host", "subtrees"])

    return common.in_python(pages.select("key", "url", "html"), hashes, "key long, host string, subtrees array<long>")


def extract(pages: DataFrame, least: int = PAGES, share: float = SHARE, broadcast: int = TEMPLATES) -> DataFrame:
    """(page_id, host, text, removed) of each row of ``pages`` (page_id, url, html)."""
    spark = pages.sparkSession
    source = pages.select(F.xxhash64(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))).alias("key"), "page_id", "url", "html")
    found = common.written(_found(source).dropDuplicates(["key"]), "subtrees")
    sizes = found.groupBy("host").agg(F.count("*").alias("pages"))
    counts = found.select("host", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    template = counts.join(common.small(sizes), "host").filter(F.col("n") >= share * F.col("pages")).select("subtree")
    template = common.written(template, "template")
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, host string, text string, removed long"

    def batch_of(batch, templates):
        hosts, texts, gone = [], [], []
        for url, html, own in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), templates, strict=True):
            hosts.append(host_of(url))
            body, n = content(parse(html or ""), hosts[-1], own)
            texts.append(body)
            gone.append(n)
        return pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(hosts, pa.string()), pa.array(texts, pa.string()), pa.array(gone, pa.int64())], names=["page_id", "host", "text", "removed"])

    if template.count() <= broadcast:
        shared = spark.sparkContext.broadcast(frozenset(template.toArrow().column("subtree").to_pylist()))

        def cut(batches):
            for batch in batches:
                yield batch_of(batch, [shared.value] * batch.num_rows)

        return common.in_python(source, cut, schema)
    own = found.select("key", F.explode("subtrees").alias("subtree")).join(template, "subtree").groupBy("key").agg(F.collect_set("subtree").alias("own"))

    def cut_own(batches):
        for batch in batches:
            yield batch_of(batch, [frozenset(x or ()) for x in batch.column("own").to_pylist()])

    return common.in_python(source.join(own, "key", "left"), cut_own, schema)
