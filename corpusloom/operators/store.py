"""Stored crawl results: overview, dump, media types, redirects, versioned lists, saved classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.functions.tables import small
from corpusloom.operators import state


def put(results: DataFrame, more: DataFrame) -> DataFrame:
    """Results with newer ones: the last write of each url wins."""
    return state.latest(results.unionByName(more), "url", "created_at")


def get(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """Batch lookup by url."""
    return results.join(wanted.select("url").distinct(), "url", "left_semi")


def overview(results: DataFrame, states: DataFrame, headers: bool = True, links: bool = True) -> DataFrame:
    """Results with their link states, if they have one; wide columns only if asked for."""
    drop = [c for c, keep in (("headers", headers), ("links", links)) if not keep and c in results.columns]
    return results.drop(*drop).join(states, "url", "left")


def statistics(frontier: DataFrame, results: DataFrame, states: DataFrame) -> DataFrame:
    """One row: sizes of the frontier, the results and the states."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(frontier, "frontier").crossJoin(one(results, "results")).crossJoin(one(states, "states"))


def dump(results: DataFrame, path: str) -> None:
    """Write results as JSON lines and the different archive paths of ``stored.pointers`` as text."""
    results.write.mode("overwrite").json(f"{path}/meta")
    if "stored" in results.columns:
        results.select(F.explode("stored.pointers.path").alias("value")).distinct().write.mode("overwrite").text(f"{path}/archives")


_PARAMETER = r';\s*([^=;\s]+)\s*=\s*("(?:[^"\\]|\\.)*"|[^;]*)'


def media_type(value: Column) -> Column:
    """struct(type, subtype, parameters): lower case, parameters sorted by name, quotes and escapes resolved."""
    full = F.lower(F.trim(F.regexp_extract(value, "^([^;]*)", 1)))

    def parameter(p: Column) -> Column:
        own = F.trim(F.regexp_extract(p, _PARAMETER, 2))
        plain = F.when(own.startswith('"'), F.regexp_replace(F.regexp_replace(own, '^"|"$', ""), r"\\(.)", "$1")).otherwise(own)
        return F.concat(F.lower(F.regexp_extract(p, _PARAMETER, 1)), F.lit("="), plain)

    pairs = F.transform(F.regexp_extract_all(value, F.lit(_PARAMETER), F.lit(0)), parameter)
    return F.struct(F.regexp_extract(full, "^([^/]*)", 1).alias("type"), F.regexp_extract(full, "/(.*)$", 1).alias("subtype"), F.array_sort(pairs).alias("parameters"))


#: Media type of a record by format, where neither a header nor the content says one.
MEDIA_TYPES = {"HTML": "text/html", "PDF": "application/pdf", "JavaScript": "application/javascript", "PlainText": "text/plain", "JSON": "application/json", "XML": "application/xml", "RTF": "application/rtf", "OOXML": "application/vnd.openxmlformats-officedocument", "ODF": "application/vnd.oasis.opendocument", "IMAGE": "image/*", "SVG": "image/svg+xml", "ZIP": "application/zip", "StructuredPlainText": "text/*"}


def best_media_type(mimes: Column, detected: Column, format_: Column) -> Column:
    """The first of ``mimes``, else the detected type, else that of the format, else application/octet-stream."""
    by_format = F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair))
    return F.coalesce(F.get(mimes, F.lit(0)), detected, F.element_at(by_format, format_), F.lit("application/octet-stream"))


def response_records(fetched: DataFrame) -> DataFrame:
    """Fetch results (url, final_url, status, headers, body, ..) as response records: ``url`` is where the fetch
    ended, ``requested`` where it began, ``content_length`` the size of the body."""
    rest = [c for c in fetched.columns if c not in ("url", "final_url")]
    return fetched.select(F.coalesce("final_url", "url").alias("url"), F.col("url").alias("requested"), *rest, F.octet_length("body").cast("long").alias("content_length"))


def redirect_allowed(source: Column, target: Column, policy: str = "loose") -> Column:
    """Policies: ``loose`` (all), ``host`` (same host), ``subdomain`` (the target's host ends with the source's
    origin), ``domain`` (same registrable domain)."""
    if policy == "loose":
        return F.lit(True)
    if policy == "host":
        return F.coalesce(urls.same_host(source, target), F.lit(False))
    if policy == "subdomain":
        return F.coalesce(urls.host(target).endswith(urls.origin(source)), F.lit(False))
    return F.coalesce(urls.domain(urls.host(source)) == urls.domain(urls.host(target)), F.lit(False))


def followed(hops: DataFrame, limit: int = 5, policies: tuple[str, ...] = ("host",), foreign: int = 1, most: int = 10) -> DataFrame:
    """(chain, hops, url, outcome) of redirect chains (chain, hop from 1, source, url), ``source`` being the first url.

    A hop that one of ``policies`` allows is followed up to ``most``; ``foreign`` others are; after ``limit`` hops the
    next foreign one is an error. Outcomes: ``final``, ``stopped`` (a hop isn't followed), ``too many``.
    """
    own = F.lit(False)
    for policy in policies:
        own = own | redirect_allowed(F.col("source"), F.col("url"), policy)
    chains = hops.withColumn("own", own).groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("hop", "own", "url"))).alias("h"), F.first("source").alias("source"))

    def step(a: Column, x: Column) -> Column:
        n = a["hops"] + 1
        many = (x["own"] & (n > most)) | (~x["own"] & (n > limit))
        go = x["own"] | (a["used"] < foreign)
        after = F.struct(n.alias("hops"), (a["used"] + F.when(x["own"], 0).otherwise(1)).alias("used"), x["url"].alias("url"), F.lit("final").alias("outcome"))
        ended = lambda why: F.struct(a["hops"].alias("hops"), a["used"].alias("used"), a["url"].alias("url"), F.lit(why).alias("outcome"))
        return F.when(a["outcome"] != "final", a).when(many, ended("too many")).when(go, after).otherwise(ended("stopped"))

    start = F.struct(F.lit(0).alias("hops"), F.lit(0).alias("used"), F.col("source").alias("url"), F.lit("final").alias("outcome"))
    return chains.select("chain", F.aggregate("h", start, step).alias("r")).select("chain", "r.hops", "r.url", "r.outcome")


def patch(patterns: DataFrame, version: int) -> DataFrame:
    """Patterns that were added after a version."""
    return patterns.filter(F.col("version") > version)


def apply_patch(patterns: DataFrame, more: DataFrame) -> DataFrame:
    """Patterns of both; those that are known keep their version."""
    new = more.join(patterns.select("pattern"), "pattern", "left_anti")
    return patterns.unionByName(new.select(*patterns.columns))


def next_serial(names: Column, pattern: str = "([0-9]+)") -> Column:
    """Aggregate: one more than the greatest serial number in the names."""
    return F.coalesce(F.max(F.regexp_extract(names, pattern, 1).try_cast("bigint")), F.lit(0)) + 1


def classifier_for(docs: DataFrame, registry: DataFrame, default: str, least: float) -> DataFrame:
    """``docs`` (.., lang, confidence) with ``model``: that of the language if confidence reaches ``least``.

    ``registry`` (lang, model) has a row a language and is broadcast.
    """
    own = F.when(F.col("confidence") >= least, F.col("_model"))
    return docs.join(small(registry.withColumnRenamed("model", "_model")), "lang", "left").withColumn("model", F.coalesce(own, F.lit(default))).drop("_model")


def save_classifier(weights: DataFrame, bias: float, path: str) -> None:
    weights.unionByName(weights.sparkSession.createDataFrame([(None, bias)], weights.schema)).write.mode("overwrite").parquet(path)


def load_classifier(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    rows = spark.read.parquet(path)
    return rows.filter("term is not null"), rows.filter("term is null").first().weight
