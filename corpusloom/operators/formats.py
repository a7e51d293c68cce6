"""File formats, charsets and languages of fetched bytes or text."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import markup, terms, urls
from corpusloom.functions.tables import small

BY_EXTENSION = {"html": "HTML", "htm": "HTML", "xhtml": "HTML", "pdf": "PDF", "js": "JavaScript", "txt": "PlainText", "csv": "StructuredPlainText", "json": "JSON", "xml": "XML", "svg": "SVG", "rtf": "RTF", "xlsx": "OOXML", "docx": "OOXML", "pptx": "OOXML", "odt": "ODF", "ods": "ODF", "png": "IMAGE", "jpg": "IMAGE", "jpeg": "IMAGE", "gif": "IMAGE", "zip": "ZIP", "jar": "ZIP"}
BY_MIME = {"text/html": "HTML", "application/xhtml+xml": "HTML", "application/pdf": "PDF", "text/javascript": "JavaScript", "application/javascript": "JavaScript", "text/plain": "PlainText", "application/json": "JSON", "text/xml": "XML", "application/xml": "XML", "image/svg+xml": "SVG", "application/rtf": "RTF", "text/rtf": "RTF", "image/png": "IMAGE", "image/jpeg": "IMAGE", "application/zip": "ZIP"}
BOMS = {"EFBBBF": "utf-8", "FFFE": "utf-16-le", "FEFF": "utf-16-be"}


def lookup(value: Column, table: dict[str, str]) -> Column:
    out: Column | None = None
    for key, name in table.items():
        out = F.when(value == key, name) if out is None else out.when(value == key, name)
    return out


def format_of(text: Column, mime: Column, url: Column) -> Column:
    """Content signature, else mime, else extension, else an HTML heuristic, else Unknown."""
    signature = F.when(text.startswith("%PDF-"), "PDF").when(text.startswith("{\\rtf"), "RTF").when(text.startswith("PK\u0003\u0004"), "ZIP").when(markup.looks_like_html(text), "HTML").when(text.rlike(r"^\s*<\?xml"), "XML")
    return F.coalesce(signature, lookup(F.lower(mime), BY_MIME), lookup(F.lower(urls.last_extension(url)), BY_EXTENSION), F.lit("Unknown"))


def votes(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, format, votes): the format with most signals of (key, format); ties by name."""
    counted = rows.filter("format is not null").groupBy(key, "format").agg(F.count("*").alias("votes"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("votes"), "format"))
    return counted.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def bom(content: Column) -> Column:
    """Encoding of a byte-order mark, or null."""
    mark = F.hex(F.substring(content, 1, 3))
    return F.when(mark == "EFBBBF", "utf-8").when(mark.startswith("FFFE"), "utf-16-le").when(mark.startswith("FEFF"), "utf-16-be")


def decoded(rows: DataFrame, limit: int = 100 << 20) -> DataFrame:
    """``rows`` (.., content, charsets) with text, encoding and had_errors.

    A byte-order mark decides; then each charset in turn, the first without errors; then UTF-8 and
    Windows-1252; contents longer than ``limit`` stay undecoded.
    """

    @F.pandas_udf("text string, encoding string, had_errors boolean")
    def decode(content: pd.Series, charsets: pd.Series, mark: pd.Series) -> pd.DataFrame:
        out = []
        for raw, names, by_mark in zip(content, charsets, mark, strict=True):
            if raw is None or len(raw) > limit:
                out.append((None, None, None))
                continue
            raw = bytes(raw)
            options = [by_mark] if by_mark else [*(names if names is not None else ()), "utf-8", "windows-1252"]
            for name in options:
                try:
                    codec = codecs.lookup(name).name
                    out.append((raw.decode(codec).removeprefix("﻿"), codec, False))
                    break
                except (LookupError, UnicodeDecodeError):
                    continue
            else:
                out.append((raw.decode("utf-8", "replace"), "utf-8", True))
        return pd.DataFrame(out, columns=["text", "encoding", "had_errors"])

    return rows.withColumn("_d", decode("content", "charsets", bom(F.col("content")))).select(*rows.columns, "_d.text", "_d.encoding", "_d.had_errors")


def language_by_stopwords(docs: DataFrame, stopwords: DataFrame) -> DataFrame:
    """(doc_id, guess, hits): the language with most stop words in the text; ties by name; none gives no row."""
    hits = terms.tokens(docs).join(small(stopwords), "term").groupBy("doc_id", "lang").agg(F.count("*").alias("hits"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("hits"), "lang"))
    return hits.withColumn("_rank", rank).filter("_rank = 1").select("doc_id", F.col("lang").alias("guess"), "hits")


METHODS = {"HTML": "html raw", "JavaScript": "js raw", "PlainText": "plain raw", "StructuredPlainText": "plain raw", "JSON": "plain raw", "XML": "xml raw", "SVG": "svg xml", "RTF": "rtf raw", "OOXML": "ooxml", "ODF": "odf", "ZIP": "zip", "Unknown": "raw"}


def extractors(rows: DataFrame) -> DataFrame:
    """``rows`` (.., format) joined with the extraction methods that suit the format (a fixed table, broadcast)."""
    table = [(f, m, i) for f, own in METHODS.items() for i, m in enumerate(own.split())]
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(table, "format string, method string, priority int")), "format")


def size_gate(size: Column, memory: int = 100 << 20, most: int | None = None) -> Column:
    """Where a body goes: ``memory``, ``file`` or, beyond ``most`` bytes, ``skip``."""
    skip = F.lit(False) if most is None else size > most
    return F.when(skip, "skip").when(size > memory, "file").otherwise("memory")
