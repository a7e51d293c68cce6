"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading makes one partition of each file. A record has its place (path, offset, lengths), its header as a map
and promoted columns, and its body; with option ``body=false`` bodies are skipped by seeking. Writing puts one
file per task into the folder, splits bodies over ``chunk`` bytes into continuation segments, and starts a new
file beyond ``rotate`` bytes.
"""

from __future__ import annotations

import base64
import glob
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import BinaryIO

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "path string, offset long, header_length int, body_length long, version string, type string, record_id string, date timestamp, target_uri string, content_type string, segment_number int, headers map<string,string>, body binary"
MANDATORY = ("warc-record-id", "content-length", "warc-date", "warc-type")
_VERSION = re.compile(rb"WARC/(\d+\.\d+)\r\n")


class BadRecord(ValueError):
    """Bytes that aren't a WARC record."""


def digest(data: bytes) -> str:
    """Labelled 128-bit digest in base 32."""
    return "xxh128:" + base64.b32encode(xxhash.xxh3_128_digest(data)).decode().rstrip("=")


def parse_header(raw: bytes) -> tuple[str, dict[str, str]]:
    """Version and fields (names in lower case; repeated ones joined) of a header that ends with a blank line."""
    m = _VERSION.match(raw)
    if not m:
        raise BadRecord("no WARC version")
    fields: dict[str, str] = {}
    for line in raw[m.end() :].split(b"\r\n"):
        if not line:
            continue
        name, colon, value = line.partition(b":")
        if not colon or b"\n" in line:
            raise BadRecord(f"bad field {line[:40]!r}")
        key = name.strip().decode("ascii", "replace").lower()
        text = value.strip().decode("utf-8", "replace")
        fields[key] = f"{fields[key]}, {text}" if key in fields else text
    return m[1].decode(), fields


def records(stream: BinaryIO, path: str, body: bool = True) -> Iterator[tuple]:
    """All records of a stream as rows of ``SCHEMA``."""
    offset = 0
    while True:
        header = b""
        while not header.endswith(b"\r\n\r\n"):
            line = stream.readline()
            if not line:
                if header.strip():
                    raise BadRecord(f"{path}: header at {offset} isn't complete")
                return
            header += line
            if len(header) > 1 << 20:
                raise BadRecord(f"{path}: no end of header at {offset}")
        version, fields = parse_header(header)
        size = int(fields.get("content-length", "0"))
        content = stream.read(size) if body else None
        if not body:
            stream.seek(size, os.SEEK_CUR)
        if stream.read(4) != b"\r\n\r\n":
            raise BadRecord(f"{path}: record at {offset} has no end")
        date = fields.get("warc-date")
        when = datetime.fromisoformat(date.replace("Z", "+00:00")).astimezone(timezone.utc).replace(tzinfo=None) if date else None
        segment = fields.get("warc-segment-number")
        yield (path, offset, len(header), size, version, fields.get("warc-type"), fields.get("warc-record-id"), when, fields.get("warc-target-uri"), fields.get("content-type"), int(segment) if segment else None, fields, content)
        offset += len(header) + size + 4


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.body = options["path"], options.get("body", "true").lower() != "false"

    def partitions(self) -> list[InputPartition]:
        found = sorted(glob.glob(os.path.join(self.path, "**", "*.warc"), recursive=True)) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [_File(p) for p in found]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as stream:
            yield from records(stream, partition.path, self.body)


def record(fields: list[tuple[str, str]], body: bytes) -> bytes:
    """Bytes of one record."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class _Writer(DataSourceWriter):
    """Rows (target_uri, date, content_type, body, and maybe headers) become response records."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path = options["path"]
        self.chunk, self.rotate = int(options.get("chunk", 1 << 30)), int(options.get("rotate", 1 << 30))

    def write(self, rows: Iterator) -> _Written:
        os.makedirs(self.path, exist_ok=True)
        paths: list[str] = []
        stream, size = None, 0
        for row in rows:
            values = row.asDict()
            url, body = values["target_uri"] or "", bytes(values.get("body") or b"")
            identity = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, url)}>"
            when = values.get("date") or datetime(1970, 1, 1)
            shared = [("WARC-Target-URI", url), ("WARC-Date", when.strftime("%Y-%m-%dT%H:%M:%SZ")), ("Content-Type", values.get("content_type") or "application/octet-stream"), ("WARC-Payload-Digest", digest(body))]
            parts = [body[at : at + self.chunk] for at in range(0, len(body), self.chunk)] or [b""]
            for number, part in enumerate(parts, 1):
                own = [("WARC-Type", "response" if number == 1 else "continuation"), ("WARC-Record-ID", identity if number == 1 else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url}#{number}')}>"), *shared]
                if len(parts) > 1:
                    own.append(("WARC-Segment-Number", str(number)))
                    if number > 1:
                        own.append(("WARC-Segment-Origin-ID", identity))
                raw = record(own, part)
                if stream is None or size and size + len(raw) > self.rotate:
                    if stream:
                        stream.close()
                    # hidden until the job commits
                    paths.append(os.path.join(self.path, f"_part-{uuid.uuid4().hex}.warc"))
                    stream, size = open(paths[-1], "wb"), 0
                stream.write(raw)
                size += len(raw)
        if stream:
            stream.close()
        return _Written(paths)

    def commit(self, messages: list[_Written | None]) -> None:
        for message in messages:
            for path in message.paths if message else ():
                os.rename(path, os.path.join(os.path.dirname(path), os.path.basename(path)[1:]))

    def abort(self, messages: list[_Written | None]) -> None:
        for message in messages:
            for path in message.paths if message else ():
                if os.path.exists(path):
                    os.remove(path)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)


def valid(rows: DataFrame) -> DataFrame:
    """Records that have every mandatory field."""
    condition = None
    for name in MANDATORY:
        own = F.map_contains_key("headers", F.lit(name))
        condition = own if condition is None else condition & own
    return rows.filter(condition)


def bodies(rows: DataFrame) -> DataFrame:
    """(target_uri, body): segments of a record joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce("segment_number", F.lit(1)).alias("n"), "body")))
    joined = F.aggregate(F.transform(parts, lambda p: p["body"]), F.lit(b""), lambda a, b: F.concat(a, b))
    return rows.filter("type in ('response', 'continuation')").groupBy("target_uri").agg(joined.alias("body"))


def read_at(pointers: DataFrame) -> DataFrame:
    """``pointers`` (.., path, offset, header_length, body_length) with the body that lies there."""

    @F.pandas_udf("binary")
    def fetch(path: pd.Series, offset: pd.Series, header: pd.Series, size: pd.Series) -> pd.Series:
        out = []
        for p, o, h, n in zip(path, offset, header, size, strict=True):
            with open(p, "rb") as stream:
                stream.seek(int(o) + int(h))
                out.append(stream.read(int(n)))
        return pd.Series(out)

    return pointers.withColumn("body", fetch("path", "offset", "header_length", "body_length"))
