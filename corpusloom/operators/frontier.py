"""Which urls a crawl may visit next: budgets, block lists, robots rules, one url an origin, schedules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.state import DISCOVERED, STORED


def in_budget(depth: Column, kind: str, on_website: int = 0, limit: int = 0) -> Column:
    """Budget kinds: ``single``, ``seed_only`` (on_website), ``normal`` (on_website, limit), ``absolute`` (limit).

    A limit of 0 is no limit for ``on_website`` and ``absolute``.
    """
    site, far, total = (depth[x] for x in ("depth_on_website", "distance_to_seed", "total_distance_to_seed"))
    on_site = F.lit(on_website == 0) | (site < on_website)
    if kind == "single":
        return (site == 0) & (far == 0) & (total == 0)
    if kind == "seed_only":
        return (far == 0) & on_site
    if kind == "normal":
        return on_site & (far <= limit)
    return F.lit(limit == 0) | (total < limit)


def with_budgets(frontier: DataFrame, budgets: DataFrame) -> DataFrame:
    """``frontier`` (.., origin, depth) with ``in_budget`` by the budget row of each origin, else the default's.

    ``budgets`` (origin, depth_on_website, depth) has the default under a null origin, without which origins that have
    no row are out of budget. The join hashes on origin.
    """
    own = budgets.filter("origin is not null").dropDuplicates(["origin"]).select("origin", budget_kind().alias("_kind"), F.col("depth_on_website").alias("_site"), F.col("depth").alias("_limit"))
    first = budgets.filter("origin is null").select(budget_kind().alias("kind"), "depth_on_website", "depth").first()
    d, site, limit = F.col("depth"), F.coalesce("_site", F.lit(0)), F.coalesce("_limit", F.lit(0))
    on_site = (site == 0) | (d["depth_on_website"] < site)
    kinds = {
        "single": (d["depth_on_website"] == 0) & (d["distance_to_seed"] == 0) & (d["total_distance_to_seed"] == 0),
        "seed_only": (d["distance_to_seed"] == 0) & on_site,
        "normal": on_site & (d["distance_to_seed"] <= limit),
        "absolute": (limit == 0) | (d["total_distance_to_seed"] < limit),
    }
    rows = frontier.join(own, "origin", "left")
    default = F.lit(False) if first is None else in_budget(d, first.kind, first.depth_on_website or 0, first.depth or 0)
    result = F.when(F.col("_kind").isNull(), default)
    for kind, condition in kinds.items():
        result = result.when(F.col("_kind") == kind, condition)
    return rows.withColumn("in_budget", result).drop("_kind", "_site", "_limit")


def adds_value(frontier: DataFrame, guards: DataFrame) -> DataFrame:
    """``frontier`` (.., origin, depth) with ``adds_value``: the origin isn't known to ``guards`` (origin, depth), or
    the url is less deep than what was reserved there (fields in order); never without an origin."""
    known = guards.groupBy("origin").agg(F.min("depth").alias("_least"))
    found = F.when(F.col("origin").isNull(), False).otherwise(F.col("_least").isNull() | (F.col("depth") < F.col("_least")))
    return frontier.join(known, "origin", "left").withColumn("adds_value", found).drop("_least")


def budget_kind() -> Column:
    """Kind of a budget row by which of ``depth_on_website`` and ``depth`` are set."""
    site, limit = F.col("depth_on_website"), F.col("depth")
    return F.when(site.isNotNull() & limit.isNotNull(), "normal").when(site.isNotNull(), "seed_only").when(limit.isNotNull(), "absolute").otherwise("single")


def blocked(url: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches; one alternation, compiled once a task. No patterns block nothing."""
    return url.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def block_list(lines: list[str]) -> list[str]:
    """Patterns of a block list: comments and blank lines go, ``\\#`` is a hash."""
    kept = (re.sub(r"^\\#", "#", line.strip()) for line in lines if line.strip() and not line.strip().startswith("#"))
    return list(dict.fromkeys(kept))


def robots_allow(urls: DataFrame, rules: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """``urls`` (.., origin, path) with ``allowed``: the longest rule that matches decides, allow on a tie.

    A rule matches from the start of the path; ``*`` is any run of characters, ``$`` at the end the path's end. Empty
    rules match nothing. Origins without rules allow everything, those of ``failed`` (origin), whose rules couldn't
    be read, nothing. ``rules`` has origin, pattern, allow; the join hashes on origin.
    """
    keys = [c for c in urls.columns]
    hits = urls.join(rules.select("origin", "pattern", "allow"), "origin", "left")
    body = F.regexp_replace("pattern", "[$]$", "")
    literal = F.transform(F.split(body, "[*]"), lambda x: F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    regex = F.concat(F.lit("^(?s)"), F.array_join(literal, ".*"), F.when(F.col("pattern").endswith("$"), "$").otherwise(""))
    fits = F.when(F.col("pattern").contains("*") | F.col("pattern").endswith("$"), F.rlike("path", regex)).otherwise(F.col("path").startswith(F.col("pattern")))
    strength = F.when(fits & (F.col("pattern") != ""), F.struct(F.length("pattern").alias("size"), F.col("allow").alias("allow")))
    best = hits.groupBy(*keys).agg(F.max(strength).alias("best"))
    out = best.select(*keys, F.coalesce(F.col("best.allow"), F.lit(True)).alias("allowed"))
    if failed is None:
        return out
    bad = failed.select("origin").distinct().withColumn("_failed", F.lit(True))
    return out.join(bad, "origin", "left").select(*keys, (F.col("allowed") & F.col("_failed").isNull()).alias("allowed"))


def crawl_delay(robots: Column, config: Column, default: float = 1.0) -> Column:
    return F.coalesce(robots, config, F.lit(default))


def is_fresh(retrieved: Column, now: Column, seconds: float | None) -> Column:
    """Whether a cached answer may be used; without an age limit it always may."""
    if seconds is None:
        return F.lit(True)
    return now.cast("timestamp").cast("double") - retrieved.cast("timestamp").cast("double") <= seconds


def drop_reasons(**failed: Column) -> Column:
    """Names of all reasons that hold, joined by a bar; empty if the url is admitted."""
    return F.array_join(F.array_compact(F.array(*(F.when(c, name) for name, c in failed.items()))), "|")


def admit(urls: DataFrame, visited: DataFrame, patterns: list[str], allowed: Column, budget: Column) -> DataFrame:
    """Not visited, not blocked, allowed by robots and in budget; the cheap anti join first, regex last."""
    return urls.join(visited.select("url").distinct(), "url", "left_anti").filter(budget).filter(allowed).filter(~blocked(F.col("url"), patterns))


def one_per_origin(frontier: DataFrame) -> DataFrame:
    """The first url of each origin in order of entry."""
    rank = F.row_number().over(Window.partitionBy("origin").orderBy("seq"))
    return frontier.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def schedule(frontier: DataFrame, delay: Column) -> DataFrame:
    """Seconds from the start at which each url may be fetched: its turn at its origin times the delay."""
    turn = F.row_number().over(Window.partitionBy("origin").orderBy("seq"))
    return frontier.withColumn("at", (turn - 1) * delay)


def requeue(frontier: DataFrame, claimed: DataFrame, max_age: int = 20) -> DataFrame:
    """Unclaimed elements come back one older; those older than ``max_age`` (0: no limit) go."""
    rest = frontier.join(claimed.select("seq"), "seq", "left_anti").withColumn("age", F.col("age") + 1)
    return rest.filter(F.col("age") <= max_age) if max_age else rest


def still_wanted(queue: DataFrame, states: DataFrame, max_age: int = 20) -> DataFrame:
    """Queue elements that the state of their url keeps: unknown, discovered, or stored and to be recrawled."""
    joined = queue.join(states.select("url", F.col("kind").alias("_kind"), F.col("recrawl").alias("_recrawl")), "url", "left")
    keep = F.col("_kind").isNull() | (F.col("_kind") == DISCOVERED) | ((F.col("_kind") == STORED) & F.coalesce("_recrawl", F.lit(False)))
    young = (F.col("age") <= max_age) if max_age else F.lit(True)
    return joined.filter(keep & young).drop("_kind", "_recrawl")


def page_after(rows: DataFrame, key: str, after: str | None, size: int = 10) -> DataFrame:
    """Keyset pagination: the next ``size`` rows by key."""
    return (rows if after is None else rows.filter(F.col(key) > after)).orderBy(key).limit(size)


def due(urls_: DataFrame, access: DataFrame, now: Column, seconds: float, key: str = "origin") -> DataFrame:
    """``urls_`` with ``due``: never accessed, or longer ago than the interval. ``access`` has key, last_access."""
    age = now.cast("timestamp").cast("double") - F.col("last_access").cast("timestamp").cast("double")
    return urls_.join(access.select(key, "last_access"), key, "left").withColumn("due", F.coalesce(age > seconds, F.lit(True)))
