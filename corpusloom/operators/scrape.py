"""Links in documents that aren't HTML: XML, SVG, RTF, office files, archives, scripts, plain text and bytes."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from corpusloom.functions import page, strings, weburl
from corpusloom.operators.formats import BY_EXTENSION
from corpusloom.sources.lines import zip_members

_RTF = re.compile(r'HYPERLINK\s+(?:\\\\[a-z]\s+)*"([^"]+)"')


def _elements(content: bytes) -> Iterator[ElementTree.Element]:
    """Elements of an XML document up to where it stops being well formed."""
    parser = ElementTree.XMLPullParser(["start", "end"])
    try:
        parser.feed(content)
        parser.close()
    except ElementTree.ParseError:
        pass
    try:
        for event, element in parser.read_events():
            if event == "start":
                yield element
    except ElementTree.ParseError:
        return


def _named(content: bytes, *names: str) -> list[str]:
    """Values of attributes by local name."""
    return [v for e in _elements(content) for k, v in e.attrib.items() if k.rpartition("}")[2] in names]


def xml_links(content: bytes) -> list[tuple[str, str]]:
    found = [("XmlAttribute", v) for v in _named(content, "href", "src", "action", "schemaLocation") for v in ([v] if " " not in v.strip() else v.split()[1::2])]
    for element in _elements(content):
        found += [("XmlText", u) for t in (element.text, element.tail) if t for u in page.plain_urls(t)]
    return found


def rtf_links(content: bytes) -> list[tuple[str, str]]:
    return [("Rtf", u) for u in _RTF.findall(content.decode("latin-1"))]


def office_links(content: bytes, kind: str) -> list[tuple[str, str]]:
    """External targets of the relationships of OOXML, or references of ODF content."""
    out: list[tuple[str, str]] = []
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        for name in archive.namelist():
            if kind == "OOXML" and name.endswith(".rels"):
                out += [("Ooxml", e.attrib["Target"]) for e in _elements(archive.read(name)) if e.attrib.get("TargetMode") == "External" and "Target" in e.attrib]
            elif kind == "ODF" and name.endswith(".xml"):
                out += [("Odf", v) for v in _named(archive.read(name), "href") if "://" in v or v.startswith("mailto:")]
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError):
        pass
    return out


def kind_of(content: bytes, name: str = "") -> str:
    """Format by extension, else by the first bytes."""
    known = BY_EXTENSION.get(name.rpartition(".")[2].lower()) if "." in name else None
    head = content[:512].lstrip()
    if known:
        return known
    if head[:4] == b"PK\x03\x04":
        return "ZIP"
    if head[:5] == b"{\\rtf":
        return "RTF"
    if re.match(rb"(?i)<!doctype html|<html", head):
        return "HTML"
    if head[:5] == b"<?xml":
        return "SVG" if b"<svg" in content[:2_048] else "XML"
    try:
        content.decode("utf-8")
        return "PlainText"
    except UnicodeDecodeError:
        return "Unknown"


def links_of(content: bytes, kind: str) -> list[tuple[str, str]]:
    """(method, target) of one document; bytes are searched for urls where its own methods find none."""
    text = lambda: content.decode("utf-8", "replace")
    if kind == "HTML":
        follows, base, found = page.links(text())
        if not follows:
            return []
        found = [(m, weburl.resolve(base, t) or t) for m, t in found] if base and "://" in base else found
    elif kind == "JavaScript":
        found = [("JavaScript", u) for u in strings.script_links(text())]
    elif kind in ("PlainText", "StructuredPlainText", "JSON"):
        found = [("PlainText", u) for u in page.plain_urls(text())]
    elif kind == "XML":
        found = xml_links(content)
    elif kind == "SVG":
        found = [("Svg", v) for v in _named(content, "href")]
    elif kind == "RTF":
        found = rtf_links(content)
    elif kind in ("OOXML", "ODF"):
        found = office_links(content, kind)
    else:
        found = []
    return found or [("Raw", u) for u in strings.raw_urls(content)]


def document_links(rows: DataFrame, max_depth: int = 10, max_bytes: int | None = 100 << 20) -> DataFrame:
    """(key, zip_path, method, dst) of ``rows`` (key, url, format, content), archives opened.

    ``format`` may be null: it is found by the url's extension and the content. Links of archive members have the
    path of the member and no base, so only absolute ones count; the others are resolved against ``url``.
    """

    def each(content: bytes, url: str | None, kind: str | None) -> Iterator[tuple[str | None, str, str]]:
        own = kind or kind_of(content, (url or "").partition("?")[0].partition("#")[0].rpartition("/")[2])
        if own == "ZIP":
            for path, data, problem in zip_members(content, (), max_depth, max_bytes):
                if not problem:
                    for method, target in links_of(data, kind_of(data, path[-1])):
                        dst = weburl.normal(target)
                        if dst:
                            yield "!".join(path), method, dst
            return
        for method, target in links_of(content, own):
            dst = weburl.resolve(url, target)
            if dst and dst != weburl.normal(url):
                yield None, method, dst

    def run(batches):
        for pdf in batches:
            out = []
            for key, url, kind, content in zip(pdf.key, pdf.url, pdf.format, pdf.content, strict=True):
                if content is not None:
                    out += dict.fromkeys((key, *row) for row in each(bytes(content), url, kind if isinstance(kind, str) else None))
            yield pd.DataFrame(out, columns=["key", "zip_path", "method", "dst"])

    key = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "url", "format", "content").mapInPandas(run, f"key {key}, zip_path string, method string, dst string")
