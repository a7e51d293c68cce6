"""URL and crawl-depth functions as Spark columns.

Parts of urls are regular expressions in the JVM. Normal forms, resolution and registrable domains follow
public standards that no built-in has; they run in Python on the different values of Arrow batches.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import suffixes, weburl

SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"
HOST = AUTHORITY + r"(?:[^/?#@]*@)?([^/?#:]*)"
PORT = AUTHORITY + r"(?:[^/?#@]*@)?[^/?#:]*:([0-9]+)"
PATH = AUTHORITY + r"[^/?#]*([^?#]*)"
QUERY = r"^[^?#]*[?]([^#]*)"
def strip_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def strip_query(url: Column) -> Column:
    return F.regexp_replace(url, "[?][^#]*", "")


def strip_password(url: Column) -> Column:
    return F.regexp_replace(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#@:]*):[^/?#@]*@", "$1@")


def strip_user(url: Column) -> Column:
    return F.regexp_replace(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://)[^/?#@]*@", "$1")


def strip_port(url: Column) -> Column:
    return F.regexp_replace(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*):[0-9]*", "$1")


def strip_path(url: Column) -> Column:
    return F.regexp_replace(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)[^?#]*", "$1/")


def clean(url: Column) -> Column:
    """Without fragment, query and password."""
    return strip_password(strip_query(strip_fragment(url)))


def _part(url: Column, pattern: str) -> Column:
    found = F.regexp_extract(url, pattern, 1)
    return F.when(found != "", found)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, SCHEME))


def host(url: Column) -> Column:
    return F.lower(_part(url, HOST))


def port(url: Column) -> Column:
    return _part(url, PORT).cast("bigint")


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def query(url: Column) -> Column:
    return _part(url, QUERY)


def file_name(url: Column) -> Column:
    return _part(path(url), "([^/]*)$")


def extensions(url: Column) -> Column:
    """All extensions after the first dot of the file name."""
    parts = F.split(F.coalesce(file_name(url), F.lit("")), "[.]")
    return F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x != "")


def last_extension(url: Column) -> Column:
    return _part(F.coalesce(file_name(url), F.lit("")), r"[.]([^.]+)$")


def _mapped(values: pd.Series, function) -> pd.Series:
    """``function`` of each value, called once for different ones; nulls stay."""
    codes, unique = pd.factorize(values)
    found = pd.Series([*map(function, unique), None], dtype=object)
    return found.take(codes).reset_index(drop=True)


@lru_cache(maxsize=4)
def _domains(path: str | None):
    known = suffixes.rules(path)

    @F.pandas_udf(T.StringType())
    def found(host_: pd.Series) -> pd.Series:
        return _mapped(host_, lambda h: suffixes.registrable(h, known))

    return found


def domain(host_: Column, path: str | None = None) -> Column:
    """Registrable domain by the public suffix list (``path``, else the one of Spark's distribution); addresses and
    suffixes have none."""
    return _domains(path)(host_)


@F.pandas_udf(T.StringType())
def normal(url: pd.Series) -> pd.Series:
    """Normal form of absolute urls by the URL standard; null where there is none."""
    return _mapped(url, weburl.normal)


def origin(url: Column) -> Column:
    """Registrable domain, else host."""
    h = host(url)
    return F.coalesce(domain(h), h)


def same_host(a: Column, b: Column) -> Column:
    """Null if one of the urls has no host."""
    return host(a) == host(b)


@F.pandas_udf(T.StringType())
def resolve(base: pd.Series, target: pd.Series) -> pd.Series:
    """Targets seen from ``base``, by the URL standard; null where the result isn't a url."""
    return pd.Series([weburl.resolve(b, t) for b, t in zip(base, target, strict=True)], dtype=object)


def depth(on_website, distance, total) -> Column:
    return F.struct(F.lit(on_website).alias("depth_on_website"), F.lit(distance).alias("distance_to_seed"), F.lit(total).alias("total_distance_to_seed"))


def child_depth(parent: Column, base: Column, target: Column) -> Column:
    """Same host: one deeper on the website; other host, or a base without host: a new website, one further."""
    a, b = host(base), host(target)
    leaves = (a.isNull() & b.isNotNull()) | ((a != b) & a.isNotNull() & b.isNotNull())
    on, far, total = (parent[x] for x in ("depth_on_website", "distance_to_seed", "total_distance_to_seed"))
    return depth(F.when(leaves, F.lit(0)).otherwise(on + 1), F.when(leaves, far + 1).otherwise(far), total + 1)


def _fields(a: Column, b: Column, f) -> Column:
    names = ("depth_on_website", "distance_to_seed", "total_distance_to_seed")
    return depth(*(f(a[n], b[n]) for n in names))


def depth_min(a: Column, b: Column) -> Column:
    return _fields(a, b, F.least)


def depth_max(a: Column, b: Column) -> Column:
    return _fields(a, b, F.greatest)


def depth_add(a: Column, b: Column) -> Column:
    return _fields(a, b, lambda x, y: x + y)


def depth_subtract(a: Column, b: Column) -> Column:
    return _fields(a, b, lambda x, y: x - y)


def depth_is_zero(a: Column) -> Column:
    return (a["depth_on_website"] == 0) & (a["distance_to_seed"] == 0) & (a["total_distance_to_seed"] == 0)
