"""Public suffixes: registrable domains by the list that Spark's distribution carries, or by another file."""

from __future__ import annotations

import glob
import os
import zipfile
from functools import lru_cache

import pyspark

#: Member of Spark's HTTP client jar, in the format of the public suffix list.
MEMBER = "mozilla/public-suffix-list.txt"


@lru_cache(maxsize=4)
def rules(path: str | None = None) -> frozenset[str]:
    """Rules of the list at ``path``, else of the one among Spark's jars, else none (one label is the suffix)."""
    text = ""
    if path is not None:
        with open(path, encoding="utf-8") as file:
            text = file.read()
    else:
        homes = [os.path.dirname(pyspark.__file__), os.environ.get("SPARK_HOME", "")]
        for jar in sorted(j for home in homes if home for j in glob.glob(os.path.join(home, "jars", "httpclient*.jar"))):
            with zipfile.ZipFile(jar) as archive:
                if MEMBER in archive.namelist():
                    text = archive.read(MEMBER).decode("utf-8")
                    break
    lines = (line.strip() for line in text.splitlines())
    out = set()
    for line in lines:
        if line and not line.startswith("//"):
            rule = line.split()[0].lower()
            out.add(rule)
            out.add(".".join(p if p.isascii() else "xn--" + p.encode("punycode").decode() for p in rule.split(".")))
    return frozenset(out)


def registrable(host: str, known: frozenset[str]) -> str | None:
    """The label before the longest public suffix, with it; none for addresses and suffixes themselves."""
    labels = host.rstrip(".").lower().split(".")
    if host.startswith("[") or labels[-1].isdigit() or not labels[-1]:
        return None
    size = 1
    for i in range(len(labels)):
        name = ".".join(labels[i:])
        if "!" + name in known:
            size = len(labels) - i - 1
            break
        if name in known or "*." + ".".join(labels[i + 1 :]) in known:
            size = len(labels) - i
            break
    return ".".join(labels[-size - 1 :]) if len(labels) > size and all(labels[-size - 1 :]) else None
