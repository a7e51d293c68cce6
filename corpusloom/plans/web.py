"""Queries over pages: urls, depths, links, the web graph, markup, formats and the frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import markup, page, urls
from corpusloom.operators import formats, frontier, links, order, state
from corpusloom.plans.registry import query

_HOST = r"lower(nullif(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), ''))"
_PATH = r"regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_NAME = f"nullif(regexp_extract({_PATH}, '([^/]*)$', 1), '')"
# hosts of the tables have suffixes of one label; other hosts are in the queries with expected tables
_ORIGIN = f"coalesce(nullif(regexp_extract({_HOST}, '([a-z0-9-]+[.][a-z]+)$', 1), ''), {_HOST})"
_BARE = "regexp_replace({u}, '#.*$', '')"


def sql_host(u: str) -> str:
    return _HOST.replace("{u}", u)


def sql_path(u: str) -> str:
    return _PATH.replace("{u}", u)


def sql_origin(u: str) -> str:
    return _ORIGIN.replace("{u}", u)


def sql_bare(u: str) -> str:
    return _BARE.replace("{u}", u)


# links of the tables are root-relative; other kinds are in the queries with expected tables
_SEEN = r"regexp_replace(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>', ' ', 'g')"
LINKS = rf"""(with raw as (select page_id, split_part(url, '#', 1) as src, unnest(list_distinct(regexp_extract_all({_SEEN}, '<a [^>]*?href="([^"]*)"', 1))) as href from pages),
  res as (select page_id, src, regexp_extract(src, '^[a-z]+://[^/]+') || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') as dst from raw)
  select distinct page_id, src, dst from res where dst <> src)"""


@query("url_clean", "pages", rf"""select page_id, {sql_bare('url')} as no_fragment,
    regexp_replace(regexp_replace({sql_bare('url')}, '[?][^#]*', ''), '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#@:]*):[^/?#@]*@', '\1@') as clean,
    regexp_replace(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)[^?#]*', '\1/') as no_path from pages""")
def url_clean(pages: DataFrame) -> DataFrame:
    url = F.col("url")
    return pages.select("page_id", urls.strip_fragment(url).alias("no_fragment"), urls.clean(url).alias("clean"), urls.strip_path(url).alias("no_path"))


@query("url_parts", "pages", rf"""select page_id, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) as scheme, {sql_host('url')} as host,
    {sql_path('url')} as path, nullif(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '') as query, {sql_origin('url')} as origin from pages""")
def url_parts(pages: DataFrame) -> DataFrame:
    url = F.col("url")
    return pages.select("page_id", urls.scheme(url).alias("scheme"), urls.host(url).alias("host"), urls.path(url).alias("path"), urls.query(url).alias("query"), urls.origin(url).alias("origin"))


@query("url_extensions", "pages", rf"""select page_id, {_NAME.replace('{u}', 'url')} as name,
    array_to_string(list_filter(string_split(coalesce({_NAME.replace('{u}', 'url')}, ''), '.')[2:], lambda x: x <> ''), ',') as extensions,
    nullif(regexp_extract(coalesce({_NAME.replace('{u}', 'url')}, ''), '[.]([^.]+)$', 1), '') as last from pages""")
def url_extensions(pages: DataFrame) -> DataFrame:
    url = F.col("url")
    return pages.select("page_id", urls.file_name(url).alias("name"), F.array_join(urls.extensions(url), ",").alias("extensions"), urls.last_extension(url).alias("last"))


@query("origin_pages", "pages", f"select {sql_origin('url')} as origin, count(*) as pages, count(distinct {sql_host('url')}) as hosts, count(distinct {sql_bare('url')}) as urls from pages group by 1")
def origin_pages(pages: DataFrame) -> DataFrame:
    url = F.col("url")
    return pages.groupBy(urls.origin(url).alias("origin")).agg(F.count("*").alias("pages"), F.countDistinct(urls.host(url)).alias("hosts"), F.countDistinct(urls.strip_fragment(url)).alias("urls"))


@query("host_relation", "pages", f"""with links as {LINKS} select page_id, src, dst, {sql_host('src')} = {sql_host('dst')} as same_host, {sql_origin('src')} = {sql_origin('dst')} as same_origin from links""")
def host_relation(pages: DataFrame) -> DataFrame:
    src, dst = F.col("src"), F.col("dst")
    return links.page_links(pages).select("page_id", "src", "dst", urls.same_host(src, dst).alias("same_host"), (urls.origin(src) == urls.origin(dst)).alias("same_origin"))


_SEGMENTS = f"len(list_filter(string_split({sql_path('url')}, '/'), lambda x: x <> ''))"


@query("depth_algebra", "pages", f"""select page_id, least(n, 2) as least_site, greatest(n, 2) as most_site, n + 2 as sum_site, n - 2 as gap_site, n = 0 as is_zero
    from (select page_id, {_SEGMENTS} as n from pages)""")
def depth_algebra(pages: DataFrame) -> DataFrame:
    n = F.size(F.filter(F.split(urls.path(F.col("url")), "/"), lambda x: x != "")).cast("bigint")
    rows = pages.select("page_id", F.struct(n.alias("depth_on_website"), F.lit(0).cast("bigint").alias("distance_to_seed"), F.lit(0).cast("bigint").alias("total_distance_to_seed")).alias("d"))
    d, two = F.col("d"), urls.depth(2, 0, 0)
    site = "depth_on_website"
    return rows.select("page_id", urls.depth_min(d, two)[site].alias("least_site"), urls.depth_max(d, two)[site].alias("most_site"), urls.depth_add(d, two)[site].alias("sum_site"), urls.depth_subtract(d, two)[site].alias("gap_site"), urls.depth_is_zero(d).alias("is_zero"))


@query("origin_depth", "pages", f"select {sql_origin('url')} as origin, min({_SEGMENTS}) as least, max({_SEGMENTS}) as most from pages group by 1")
def origin_depth(pages: DataFrame) -> DataFrame:
    n = F.size(F.filter(F.split(urls.path(F.col("url")), "/"), lambda x: x != "")).cast("bigint")
    return pages.groupBy(urls.origin(F.col("url")).alias("origin")).agg(F.min(n).alias("least"), F.max(n).alias("most"))


@query("page_links", "pages", f"select * from {LINKS}")
def page_links(pages: DataFrame) -> DataFrame:
    return links.page_links(pages)


@query("host_link_stats", "pages", f"with links as {LINKS} select {sql_host('src')} as host, count(*) as links, count(distinct dst) as targets from links group by 1")
def host_link_stats(pages: DataFrame) -> DataFrame:
    """Distinct links and link targets of each host."""
    return links.page_links(pages).groupBy(urls.host(F.col("src")).alias("host")).agg(F.count("*").alias("links"), F.countDistinct("dst").alias("targets"))


@query("link_depth_class", "pages", f"""with links as {LINKS}, d as (select *, {sql_host('src')} as a, {sql_host('dst')} as b from links)
    select page_id, src, dst, case when starts_with(lower(dst), 'data:') then 'data' when (a is null and b is not null) or (a <> b) is true then 'outgoing' else 'on_seed' end as link_type,
    case when (a is null and b is not null) or (a <> b) is true then 0 else 1 end as site, case when (a is null and b is not null) or (a <> b) is true then 1 else 0 end as far, 1 as total from d""")
def link_depth_class(pages: DataFrame) -> DataFrame:
    d = F.col("depth")
    return links.classified(links.page_links(pages)).select("page_id", "src", "dst", "link_type", d["depth_on_website"].alias("site"), d["distance_to_seed"].alias("far"), d["total_distance_to_seed"].alias("total"))


_EDGES = f"""links as {LINKS}, ends as (select src as u from links union select dst from links),
    edges as (select distinct src as subject, 'links_to' as predicate, dst as object from links union all select u, 'has_origin', {sql_origin('u')} from ends where {sql_origin('u')} is not null)"""


@query("web_graph_edges", "pages", f"with {_EDGES} select * from edges")
def web_graph_edges(pages: DataFrame) -> DataFrame:
    return links.edges(links.page_links(pages))


@query("turtle_lines", "pages", f"""with {_EDGES}, seeds as (select distinct {sql_origin('url')} as o, split_part(url, '#', 1) as u from pages)
    select '<' || subject || '> :' || predicate || ' ' || case when predicate = 'has_origin' then 'o:' || object else '<' || object || '>' end || ' .' as line from edges
    union all select 'o:' || o || ' :has_seed <' || u || '> .' from seeds
    union all from (values ('@prefix : <http://example.org/crawl#> .'), ('@prefix o: <http://example.org/origin/> .'), ('@prefix ol: <http://example.org/label/> .'), ('@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .')) p(line)""")
def turtle_lines(pages: DataFrame) -> DataFrame:
    """The web graph with all pages as seeds."""
    found = links.edges(links.page_links(pages)).unionByName(links.seeds(pages.select(urls.strip_fragment(F.col("url")).alias("url"))))
    return links.turtle(found, prefixes=True)


@query("in_degree_top", "pages", f"with links as {LINKS} select dst, count(distinct src) as n from links group by 1 order by n desc, dst limit 20")
def in_degree_top(pages: DataFrame) -> DataFrame:
    return links.page_links(pages).groupBy("dst").agg(F.countDistinct("src").alias("n")).orderBy(F.desc("n"), "dst").limit(20)


@query("out_degree", "pages", f"with links as {LINKS} select src, count(distinct dst) as n from links group by 1")
def out_degree(pages: DataFrame) -> DataFrame:
    return links.page_links(pages).groupBy("src").agg(F.countDistinct("dst").alias("n"))


_NEW = f"with links as {LINKS} select distinct dst as url from links where dst not in (select {sql_bare('url')} from pages)"


@query("frontier_new_links", "pages", _NEW)
def frontier_new_links(pages: DataFrame) -> DataFrame:
    """Link targets that haven't been fetched."""
    known = pages.select(urls.strip_fragment(urls.normal(F.col("url"))).alias("url")).distinct()
    return links.page_links(pages).select(F.col("dst").alias("url")).distinct().join(known, "url", "left_anti")


@query("extracted_by_method", "pages", rf"""select method, count(*) as links, count(distinct page_id) as pages from (select distinct page_id, 'Href' as method, regexp_extract(url, '^[a-z]+://[^/]+') || replace(url_encode(unnest(regexp_extract_all({_SEEN}, '<a [^>]*?href="([^"]*)"', 1))), '%2F', '/') as dst from pages) group by 1""")
def extracted_by_method(pages: DataFrame) -> DataFrame:
    return links.extracted(pages).groupBy("method").agg(F.count("*").alias("links"), F.countDistinct("page_id").alias("pages"))


@query("nofollow_gate", "pages", f"""select page_id, true as follows, len(list_distinct(regexp_extract_all({_SEEN}, '<a [^>]*?href="([^"]*)"', 1))) as followed from pages""")
def nofollow_gate(pages: DataFrame) -> DataFrame:
    @F.pandas_udf("follows boolean, followed long")
    def gate(html):
        import pandas as pd

        found = [page.links(h or "") for h in html]
        return pd.DataFrame({"follows": [f for f, _, _ in found], "followed": [len([x for x in own if x[0] == "Href"]) for _, _, own in found]})

    return pages.select("page_id", gate("html").alias("g")).select("page_id", "g.follows", "g.followed")


@query("meta_charset", "pages", f"""select lower(nullif(regexp_extract(html, '{markup.CHARSET.replace("'", "''")}', 1), '')) as charset, count(*) as pages from pages group by 1""")
def meta_charset(pages: DataFrame) -> DataFrame:
    return pages.groupBy(markup.charset(F.col("html")).alias("charset")).agg(F.count("*").alias("pages"))


# the tags of the tables, sorted by hand
_CASES = """when tag in ('html', 'head', 'title', 'body', 'p', 'br', 'hr') or regexp_full_match(tag, 'h[1-6]') then 'basic'
    when tag in ('a', 'link', 'nav') then 'link' when tag in ('ul', 'ol', 'li', 'dl', 'dt', 'dd') then 'list' when tag = 'meta' then 'meta' when tag in ('script', 'noscript') then 'programming'
    when tag in ('div', 'span', 'footer', 'header', 'main', 'section', 'article', 'aside', 'style') then 'style' when tag in ('table', 'tr', 'td', 'th', 'thead', 'tbody') then 'table'
    when tag in ('b', 'i', 'em', 'strong', 'u', 's', 'small', 'code', 'pre', 'blockquote') then 'formatting' when tag in ('form', 'input', 'button', 'label') then 'form' when tag = 'img' then 'image'"""


@query("tag_histogram", "pages", rf"""select case {_CASES} else 'unknown' end as category, tag, count(*) as n
    from (select unnest(list_transform(regexp_extract_all(html, '{markup.TAG}', 1), lambda x: lower(x))) as tag from pages) group by 1, 2""")
def tag_histogram(pages: DataFrame) -> DataFrame:
    tag = F.explode(F.regexp_extract_all("html", F.lit(markup.TAG), F.lit(1))).alias("tag")
    return pages.select(tag).select(F.lower("tag").alias("tag")).groupBy(markup.category(F.col("tag")).alias("category"), "tag").agg(F.count("*").alias("n"))


@query("html_text", "pages", r"""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as text from pages""")
def html_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", markup.text_of(F.col("html")).alias("text"))


_LOOKS = "(starts_with(html, '<!DOCTYPE html') or case when contains(html, '</html>') then contains(split_part(html, '</html>', 1), '<html') else starts_with(html, '<html') or contains(split_part(html, '<html', 1), '<!DOCTYPE html') and contains(html, '<html') end)"


@query("html_heuristic", "pages", f"select page_id, {_LOOKS} as is_html from pages")
def html_heuristic(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", markup.looks_like_html(F.col("html")).alias("is_html"))


_EXT = f"lower(nullif(regexp_extract(coalesce({_NAME.replace('{u}', 'url')}, ''), '[.]([^.]+)$', 1), ''))"
_BY_EXT = "case " + " ".join(f"when {_EXT} = '{k}' then '{v}'" for k, v in formats.BY_EXTENSION.items()) + " end"


@query("format_vote", "pages", f"""with s as (select page_id, case when {_LOOKS} then 'HTML' end as format from pages union all select page_id, {_BY_EXT} from pages
      union all select page_id, case when regexp_matches(html, '(?i)<script') then 'HTML' end from pages),
    c as (select page_id, format, count(*) as votes from s where format is not null group by 1, 2)
    select page_id, format, votes from (select *, row_number() over (partition by page_id order by votes desc, format) as r from c) where r = 1""")
def format_vote(pages: DataFrame) -> DataFrame:
    html = F.col("html")
    signals = [F.when(markup.looks_like_html(html), "HTML"), formats.lookup(F.lower(urls.last_extension(F.col("url"))), formats.BY_EXTENSION), F.when(html.rlike("(?i)<script"), "HTML")]
    return formats.votes(pages.select("page_id", F.explode(F.array(*signals)).alias("format")))


@query("format_ladder", "pages", rf"""select page_id, coalesce(case when starts_with(html, '%PDF-') then 'PDF' when {_LOOKS} then 'HTML' when regexp_matches(html, '^\s*<\?xml') then 'XML' end, {_BY_EXT}, 'Unknown') as format from pages""")
def format_ladder(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", formats.format_of(F.col("html"), F.lit(None).cast("string"), F.col("url")).alias("format"))


# the frontier: one element for each different link, in order of url
_FRONTIER = f"""with links as {LINKS}, d as (select dst as url, min(page_id) as seq, count(*) as n from links group by 1),
    q as (select url, {sql_origin('url')} as origin, row_number() over (order by url) as seq, n, length({sql_path('url')}) % 4 as site, seq % 3 as far from d)"""


def _frontier(pages: DataFrame) -> DataFrame:
    found = links.page_links(pages).groupBy(F.col("dst").alias("url")).agg(F.min("page_id").alias("p"), F.count("*").alias("n"))
    site = (F.length(urls.path(F.col("url"))) % 4).cast("bigint")
    return order.numbered(found.select("url", urls.origin(F.col("url")).alias("origin"), "n", site.alias("site"), (F.col("p") % 3).alias("far")), "url")


for _kind, _args, _sql in (
    ("single", {}, "site = 0 and far = 0"),
    ("seed_only", {"on_website": 3}, "far = 0 and site < 3"),
    ("normal", {"on_website": 3, "limit": 1}, "site < 3 and far <= 1"),
    ("absolute", {"limit": 3}, "site + far < 3"),
):

    @query(f"budget_{_kind}", "pages", f"{_FRONTIER} select url, ({_sql}) as in_budget from q")
    def budget(pages: DataFrame, kind=_kind, args=_args) -> DataFrame:
        depth = urls.depth(F.col("site"), F.col("far"), F.col("site") + F.col("far"))
        return _frontier(pages).select("url", frontier.in_budget(depth, kind, **args).alias("in_budget"))


BLOCKED = [r"[.]net/", r"^https?://m[.]", r"/(?:and|the)$"]
_BLOCKED = "regexp_matches(url, '" + "|".join(f"(?:{p})" for p in BLOCKED) + "')"


@query("blacklist_filter", "pages", f"{_FRONTIER} select url from q where not {_BLOCKED}")
def blacklist_filter(pages: DataFrame) -> DataFrame:
    return _frontier(pages).filter(~frontier.blocked(F.col("url"), BLOCKED)).select("url")


@query("drop_reasons", "pages", f"{_FRONTIER} select url, array_to_string(list_filter([case when {_BLOCKED} then 'blocked' end, case when not (site < 3 and far <= 1) then 'budget' end, case when n > 3 then 'visited' end], lambda x: x is not null), '|') as reasons from q")
def drop_reasons(pages: DataFrame) -> DataFrame:
    depth = urls.depth(F.col("site"), F.col("far"), F.col("site") + F.col("far"))
    reasons = frontier.drop_reasons(blocked=frontier.blocked(F.col("url"), BLOCKED), budget=~frontier.in_budget(depth, "normal", 3, 1), visited=F.col("n") > 3)
    return _frontier(pages).select("url", reasons.alias("reasons"))


@query("admitted", "pages", f"{_FRONTIER} select url from q where site < 3 and far <= 1 and not {_BLOCKED} and url not in (select {sql_bare('url')} from pages)")
def admitted(pages: DataFrame) -> DataFrame:
    depth = urls.depth(F.col("site"), F.col("far"), F.col("site") + F.col("far"))
    visited = pages.select(urls.strip_fragment(F.col("url")).alias("url"))
    return frontier.admit(_frontier(pages), visited, BLOCKED, F.lit(True), frontier.in_budget(depth, "normal", 3, 1)).select("url")


@query("one_per_origin", "pages", f"{_FRONTIER} select origin, url from (select *, row_number() over (partition by origin order by seq) as r from q) where r = 1")
def one_per_origin(pages: DataFrame) -> DataFrame:
    return frontier.one_per_origin(_frontier(pages)).select("origin", "url")


@query("polite_schedule", "pages", f"{_FRONTIER} select url, (row_number() over (partition by origin order by seq) - 1) * case when ends_with(origin, '.org') then 2.5 else 1.0 end::double as at from q")
def polite_schedule(pages: DataFrame) -> DataFrame:
    delay = frontier.crawl_delay(F.when(F.col("origin").endswith(".org"), F.lit(2.5)), F.lit(None).cast("double"))
    return frontier.schedule(_frontier(pages), delay).select("url", "at")


@query("frontier_requeue", "pages", f"{_FRONTIER} select url, site + 1 as age from q where seq not in (select min(seq) from q group by origin) and site + 1 <= 3")
def frontier_requeue(pages: DataFrame) -> DataFrame:
    queue = _frontier(pages).withColumn("age", F.col("site"))
    return frontier.requeue(queue, frontier.one_per_origin(queue), max_age=3).select("url", "age")


@query("dequeue_first", "pages", f"{_FRONTIER} select seq, url from q order by seq limit 25")
def dequeue_first(pages: DataFrame) -> DataFrame:
    return _frontier(pages).orderBy("seq").limit(25).select("seq", "url")


@query("keyset_page", "pages", f"select {sql_bare('url')} as url from pages where {sql_bare('url')} > 'https://' order by 1 limit 10")
def keyset_page(pages: DataFrame) -> DataFrame:
    return frontier.page_after(pages.select(urls.strip_fragment(F.col("url")).alias("url")), "url", "https://")


@query("robots_allow", "pages", f"""with rules as (select distinct {sql_origin('url')} as origin, unnest(['/en', '/en/1', '/fr']) as pattern, unnest([false, true, false]) as allow from pages),
    u as (select page_id, {sql_origin('url')} as origin, {sql_path('url')} as path from pages),
    r as (select u.page_id, u.origin, u.path, max(case when starts_with(path, pattern) then length(pattern) * 2 + allow::int end) as best from u left join rules using (origin) group by all)
    select page_id, origin, path, coalesce(best % 2 = 1, true) as allowed from r""")
def robots_allow(pages: DataFrame) -> DataFrame:
    at = pages.select("page_id", urls.origin(F.col("url")).alias("origin"), urls.path(F.col("url")).alias("path"))
    rule = F.inline(F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(a).alias("allow")) for p, a in (("/en", False), ("/en/1", True), ("/fr", False)))))
    return frontier.robots_allow(at, at.select("origin").distinct().select("origin", rule))


@query("latest_page", "pages", f"select url, page_id from (select {sql_bare('url')} as url, page_id, row_number() over (partition by {sql_bare('url')} order by page_id desc) as r from pages) where r = 1")
def latest_page(pages: DataFrame) -> DataFrame:
    """Last write wins for each url."""
    return state.latest(pages.select(urls.strip_fragment(F.col("url")).alias("url"), "page_id"), "url", "page_id")


@query("mime_list", "pages", r"""select page_id, array_to_string(list_sort(list_distinct(list_concat(['text/html'], regexp_extract_all(html, '(?i)<meta[^>]*content="([a-z]+/[a-z+.-]+)', 1)))), ',') as mimes from pages""")
def mime_list(pages: DataFrame) -> DataFrame:
    meta = F.regexp_extract_all("html", F.lit(r'(?i)<meta[^>]*content="([a-z]+/[a-z+.-]+)'), F.lit(1))
    return pages.select("page_id", F.array_join(F.array_sort(F.array_distinct(F.concat(F.array(F.lit("text/html")), meta))), ",").alias("mimes"))


@query("packed_headers", "pages", f"""select page_id, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'content-length: ' || octet_length(encode(html)) || chr(13) || chr(10) || 'host: ' || {sql_host('url')} as header, md5(html) as digest from pages""")
def packed_headers(pages: DataFrame) -> DataFrame:
    fields = F.create_map(F.lit("content-length"), F.octet_length("html").cast("string"), F.lit("host"), urls.host(F.col("url")))
    lines = F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return pages.select("page_id", F.concat(F.lit("HTTP/1.1 200 OK\r\n"), F.array_join(lines, "\r\n")).alias("header"), F.md5("html").alias("digest"))


@query("base64_body", "pages", "select page_id, base64(encode(html)) as body from pages")
def base64_body(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.regexp_replace(F.base64(F.encode("html", "utf-8")), r"\s", "").alias("body"))
