"""Text inputs: seed lists, lists with comments and continued lines, corpora, training tables, archives."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import languages, urls


def simple_lines(text: str) -> list[str]:
    """Lines without comments; ``\\#`` is a hash, a backslash at the end joins the next line, ``\\\\`` is a backslash."""
    out: list[str] = []
    held: str | None = None
    for line in text.splitlines():
        if held is None and line.lstrip().startswith("#"):
            continue
        if held is None and line.startswith("\\#"):
            line = line[1:]
        slashes = len(line) - len(line.rstrip("\\"))
        body = line[: len(line) - slashes] + "\\" * (slashes // 2)
        whole = body if held is None else f"{held}\n{body}"
        if slashes % 2:
            held = whole
        else:
            held = None
            out.append(whole)
    if held is not None:
        out.append(held)
    return out


def parse_seeds(text: str) -> tuple[str, list[str]]:
    """Kind (file, single, multi) and values of a seed definition."""
    text = text.strip()
    if text.startswith("file:"):
        return "file", [text[5:].strip().strip('"')]
    if text.startswith("single:"):
        return "single", [text[7:].strip().strip('"')]
    if text.startswith("multi:") or text.startswith('"'):
        found = re.findall(r'"((?:[^"\\]|\\.)*)"', text)
        return ("multi" if len(found) != 1 or text.startswith("multi:") else "single"), found
    return "single", [text]


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(url): different non-blank lines that aren't comments."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("url")).filter("url <> '' and not startswith(url, '#')").select(F.regexp_replace("url", r"^\\#", "#").alias("url")).distinct()


def seed_frontier(seeds: DataFrame) -> DataFrame:
    """Frontier elements of seeds in normal form; those without an origin are in ``rejected_seeds``."""
    url = urls.strip_fragment(urls.normal(F.col("url")))
    return seeds.select(url.alias("url"), urls.origin(url).alias("origin"), urls.depth(0, 0, 0).alias("depth"), F.lit(True).alias("is_seed"), F.lit(1).alias("age"), F.lit(False).alias("host_was_in_use")).filter("origin is not null")


def rejected_seeds(seeds: DataFrame) -> DataFrame:
    """(url, reason) of the seeds that ``seed_frontier`` leaves out."""
    found = urls.normal(F.col("url"))
    reason = F.when(F.col("url").isNull() | (F.trim("url") == ""), "blank").when(found.isNull(), "not a url").when(urls.origin(found).isNull(), "no origin")
    return seeds.select("url", reason.alias("reason")).filter("reason is not null")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(text): one document a line."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """(is_class, text) of a CSV file with header; malformed rows are dropped."""
    return spark.read.csv(path, header=True, schema="is_class boolean, text string", mode="DROPMALFORMED", quote='"', escape='"', multiLine=True)


#: Languages by the names that Spark's own stop-word lists have.
STOPWORD_LISTS = {"da": "danish", "nl": "dutch", "en": "english", "fi": "finnish", "fr": "french", "de": "german", "hu": "hungarian", "it": "italian", "no": "norwegian", "pt": "portuguese", "ru": "russian", "es": "spanish", "sv": "swedish", "tr": "turkish"}


def default_stopwords(spark: SparkSession) -> DataFrame:
    """(lang, term) of the lists that Spark's distribution carries."""
    from pyspark.ml.feature import StopWordsRemover

    rows = [(lang, term) for lang, name in STOPWORD_LISTS.items() for term in StopWordsRemover.loadDefaultStopWords(name)]
    return spark.createDataFrame(rows, "lang string, term string").distinct()


def all_stopwords(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Union of stop-word tables (lang, term), each word once; codes of three letters become those of two."""
    out = first
    for table in more:
        out = out.union(table.select("lang", "term"))
    short = F.create_map(*(F.lit(x) for pair in languages.THREE_TO_TWO.items() for x in pair))
    return out.select(F.coalesce(F.element_at(short, F.col("lang")), F.col("lang")).alias("lang"), "term").distinct()


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of text files in the syntax of ``simple_lines``, each file read whole as lines may be joined."""

    @F.udf("array<string>")
    def split(text):
        return simple_lines(text)

    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(split("value")).alias("place", "line"))


def block_list_table(spark: SparkSession, path: str, version: int = 0) -> DataFrame:
    """(version, pattern) of block-list files, blank lines aside."""
    return lines_of(spark, path).filter("trim(line) <> ''").select(F.lit(version).cast("long").alias("version"), F.col("line").alias("pattern")).distinct()


def append_patterns(patterns: DataFrame, path: str) -> None:
    """Append patterns (version, pattern) to a block list's table."""
    patterns.select("version", "pattern").write.mode("append").parquet(path)


def stopwords(spark: SparkSession, path: str) -> DataFrame:
    """(lang, term) of a folder of ``<lang>.txt`` files."""
    lines = spark.read.text(f"{path.rstrip('/')}/*.txt").select(F.regexp_extract(F.input_file_name(), "([^/]+)[.]txt$", 1).alias("lang"), F.trim("value").alias("term"))
    return lines.filter("term <> ''").distinct()


def zip_members(content: bytes, path: tuple[str, ...] = (), max_depth: int = 10, max_bytes: int | None = 100 << 20) -> Iterator[tuple[tuple[str, ...], bytes | None, str | None]]:
    """(path, content, problem) of the members of an archive, nested ones opened up to ``max_depth``.

    Folders and empty members aren't given. Members over ``max_bytes`` (a limit of the reference's; none: no limit),
    encrypted and damaged ones have no content and a problem.
    """
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, ValueError):
        yield path, None, "not an archive"
        return
    for info in archive.infolist():
        if info.is_dir() or not info.file_size:
            continue
        here = (*path, info.filename)
        if max_bytes is not None and info.file_size > max_bytes:
            yield here, None, "too large"
            continue
        try:
            data = archive.read(info)
        except (RuntimeError, NotImplementedError, zipfile.BadZipFile, zlib.error, EOFError, OSError) as problem:
            yield here, None, "encrypted" if "encrypted" in str(problem) else "damaged"
            continue
        if data[:4] == b"PK\x03\x04" and len(here) < max_depth:
            yield from zip_members(data, here, max_depth, max_bytes)
        else:
            yield here, data, None


def zip_entries(rows: DataFrame, max_depth: int = 10, max_bytes: int | None = 100 << 20) -> DataFrame:
    """(key, zip_path, depth, content, problem) of the members of archives in ``rows`` (key, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, "!".join(p), len(p), d, problem) for k, c in zip(pdf.key, pdf.content, strict=True) if c is not None for p, d, problem in zip_members(bytes(c), (), max_depth, max_bytes)]
            yield pd.DataFrame(out, columns=["key", "zip_path", "depth", "content", "problem"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "content").mapInPandas(run, f"key {kind}, zip_path string, depth int, content binary, problem string")


def sitemap_urls(rows: DataFrame) -> DataFrame:
    """(url, kind) of sitemap documents (xml): page urls and nested sitemaps."""
    kinds = (("page", "//*[local-name()='url']/*[local-name()='loc']/text()"), ("sitemap", "//*[local-name()='sitemap']/*[local-name()='loc']/text()"))
    parts = [rows.select(F.explode(F.xpath("xml", F.lit(path))).alias("url"), F.lit(kind).alias("kind")) for kind, path in kinds]
    return parts[0].union(parts[1]).distinct()
