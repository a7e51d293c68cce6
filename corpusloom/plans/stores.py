"""Queries over stored results: order of urls, media types, redirects, lists, serial numbers, model choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.operators import formats, frontier, links, order, store
from corpusloom.plans.registry import query
from corpusloom.plans.web import LINKS, sql_bare, sql_host, sql_origin


@query("url_order", "pages", f"select url, row_number() over (order by url || chr(1114111)) as place from (select distinct {sql_bare('url')} as url from pages)")
def url_order(pages: DataFrame) -> DataFrame:
    """Byte order in which a longer url comes before its prefix."""
    found = pages.select(urls.strip_fragment(F.col("url")).alias("url")).distinct()
    return order.numbered(found.withColumn("key", F.concat("url", F.lit("\U0010ffff"))), "key", name="place").drop("key")


@query("media_types", "pages", """select page_id, 'text' as type, 'html' as subtype, 'charset=utf-' || (page_id % 3) || ',v=' || page_id as parameters from pages""")
def media_types(pages: DataFrame) -> DataFrame:
    header = F.concat(F.lit("Text/HTML; v="), "page_id", F.lit(' ; Charset="utf-'), F.col("page_id") % 3, F.lit('"'))
    return pages.select("page_id", store.media_type(header).alias("m")).select("page_id", "m.type", "m.subtype", F.array_join("m.parameters", ",").alias("parameters"))


@query("redirect_policies", "pages", f"""with links as {LINKS}, o as (select page_id, src, dst, {sql_host('src')} as a, {sql_host('dst')} as b, {sql_origin('src')} as x, {sql_origin('dst')} as y from links)
    select page_id, src, dst, coalesce(a = b, false) as same_host, coalesce(ends_with(b, x), false) as below, coalesce(x = y, false) as same_domain from o""")
def redirect_policies(pages: DataFrame) -> DataFrame:
    found = links.page_links(pages)
    s, d = F.col("src"), F.col("dst")
    return found.select("page_id", "src", "dst", *(store.redirect_allowed(s, d, p).alias(n) for p, n in (("host", "same_host"), ("subdomain", "below"), ("domain", "same_domain"))))


_LIST = f"(select pattern, dense_rank() over (order by pattern) as version from (select distinct {sql_host('url')} as pattern from pages))"


@query("block_list_patch", "pages", f"select pattern, version from {_LIST} where version > 5")
def block_list_patch(pages: DataFrame) -> DataFrame:
    hosts = pages.select(urls.host(F.col("url")).alias("pattern")).distinct()
    return store.patch(order.numbered(hosts, "pattern", name="version"), 5)


@query("next_serials", "pages", f"select {sql_origin('url')} as origin, coalesce(max(try_cast(nullif(regexp_extract(url, '/([0-9]+)', 1), '') as bigint)), 0) + 1 as serial from pages group by 1")
def next_serials(pages: DataFrame) -> DataFrame:
    return pages.groupBy(urls.origin(F.col("url")).alias("origin")).agg(store.next_serial(F.col("url"), "/([0-9]+)").alias("serial"))


@query("budget_kinds", "region", "select r_regionkey, case when r_regionkey in (0, 1) and r_regionkey in (0, 2) then 'normal' when r_regionkey in (0, 1) then 'seed_only' when r_regionkey in (0, 2) then 'absolute' else 'single' end as kind from region")
def budget_kinds(region: DataFrame) -> DataFrame:
    rows = region.select("r_regionkey", F.when(F.col("r_regionkey").isin(0, 1), 2).alias("depth_on_website"), F.when(F.col("r_regionkey").isin(0, 2), 1).alias("depth"))
    return rows.select("r_regionkey", frontier.budget_kind().alias("kind"))


@query("model_choice", "documents", "select doc_id, case when lang in ('de', 'en') and (doc_id % 10) / 10.0 >= 0.5 then 'model-' || lang else 'general' end as model from documents")
def model_choice(documents: DataFrame) -> DataFrame:
    registry = documents.sparkSession.createDataFrame([("de", "model-de"), ("en", "model-en")], "lang string, model string")
    rows = documents.select("doc_id", "lang", ((F.col("doc_id") % 10) / 10.0).alias("confidence"))
    return store.classifier_for(rows, registry, "general", 0.5).select("doc_id", "model")


@query("store_statistics", "pages events", f"with links as {LINKS} select (select count(distinct dst) from links) as frontier, (select count(*) from pages) as results, (select count(distinct user_id) from events) as states")
def store_statistics(pages: DataFrame, events: DataFrame) -> DataFrame:
    return store.statistics(links.page_links(pages).select("dst").distinct(), pages, events.select("user_id").distinct())


@query("recrawl_due", "pages events", "select page_id, coalesce(timestamp '2024-01-30 12:00:00' - m > interval 6 hour, true) as due from pages left join (select user_id, max(ts) as m from events group by 1) on page_id % 200 = user_id")
def recrawl_due(pages: DataFrame, events: DataFrame) -> DataFrame:
    access = events.groupBy(F.col("user_id").alias("origin")).agg(F.max("ts").alias("last_access"))
    rows = pages.select("page_id", (F.col("page_id") % 200).alias("origin"))
    return frontier.due(rows, access, F.lit("2024-01-30 12:00:00").cast("timestamp"), 6 * 3600.0).select("page_id", "due")


@query("size_gates", "pages", "select page_id, case when octet_length(encode(html)) > 9000 then 'skip' when octet_length(encode(html)) > 3000 then 'file' else 'memory' end as place from pages")
def size_gates(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", formats.size_gate(F.octet_length("html"), 3000, 9000).alias("place"))


_METHODS = ", ".join(f"('{f}', '{m}', {i})" for f, own in formats.METHODS.items() for i, m in enumerate(own.split()))


@query("extractor_plan", "pages", f"select page_id, method, priority from (select page_id, case when starts_with(html, '<') then 'HTML' else 'Unknown' end as format from pages) join (values {_METHODS}) m(format, method, priority) using (format)")
def extractor_plan(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", F.when(F.col("html").startswith("<"), "HTML").otherwise("Unknown").alias("format"))
    return formats.extractors(rows).select("page_id", "method", "priority")
