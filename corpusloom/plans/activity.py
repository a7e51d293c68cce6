"""Queries over events as a crawl log and over the star schema: state folds, windows, joins, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import state
from corpusloom.plans.registry import query

_KIND = "case event_type when 'view' then 0 when 'click' then 1 when 'signup' then 2 when 'purchase' then 3 else 32 end"
_LOG = f"(select user_id as url, event_id as seq, ts, {_KIND} as kind, case event_id % 3 when 0 then true when 1 then false end as recrawl, case event_id % 5 when 0 then true when 1 then false end as is_seed from events)"
_FOLD = f"""(with kept as (select * from (select *, max(ts) over (partition by url order by seq rows between unbounded preceding and 1 preceding) as b from {_LOG}) where b is null or ts > b),
    f as (select url, kind, coalesce(lag(kind) over w, kind) as last_kind, last_value(recrawl ignore nulls) over (w rows between unbounded preceding and current row) as recrawl,
      last_value(is_seed ignore nulls) over (w rows between unbounded preceding and current row) as is_seed, ts, row_number() over (partition by url order by seq desc) as r from kept window w as (partition by url order by seq))
    select url, kind, last_kind, recrawl, is_seed, ts from f where r = 1)"""


def log_of(events: DataFrame) -> DataFrame:
    """Events as a link-state log: user as url, type as kind, id as order of arrival."""
    kind = F.expr(_KIND)
    flag = lambda n: F.when(F.col("event_id") % n == 0, True).when(F.col("event_id") % n == 1, False)
    return events.select(F.col("user_id").alias("url"), F.col("event_id").alias("seq"), "ts", kind.alias("kind"), flag(3).alias("recrawl"), flag(5).alias("is_seed"))


@query("state_fold", "events", f"select * from {_FOLD}")
def state_fold(events: DataFrame) -> DataFrame:
    return state.fold(log_of(events))


@query("state_counts", "events", f"select kind, count(*) as n from {_FOLD} group by 1")
def state_counts(events: DataFrame) -> DataFrame:
    return state.counts(state.fold(log_of(events)))


@query("recover_set", "events", f"select url, kind from {_FOLD} where kind <> 3")
def recover_set(events: DataFrame) -> DataFrame:
    return state.to_recover(state.fold(log_of(events))).select("url", "kind")


@query("recrawl_set", "events", f"select url, ts from {_FOLD} where recrawl")
def recrawl_set(events: DataFrame) -> DataFrame:
    return state.to_recrawl(state.fold(log_of(events))).select("url", "ts")


@query("origin_last_access", "events", "select user_id as origin, max(ts) as last_access from events group by 1")
def origin_last_access(events: DataFrame) -> DataFrame:
    return state.last_access(events.select(F.col("user_id").alias("origin"), "ts"))


@query("queue_by_state", "events", f"""with s as (select url, kind, recrawl from {_FOLD}), q as (select event_id as seq, user_id as url, (event_id % 25)::int as age from events)
    select seq, q.url from q left join s using (url) where age <= 20 and (kind is null or kind = 0 or (kind = 3 and coalesce(recrawl, false)))""")
def queue_by_state(events: DataFrame) -> DataFrame:
    from corpusloom.operators import frontier

    queue = events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("url"), (F.col("event_id") % 25).cast("int").alias("age"))
    return frontier.still_wanted(queue, state.fold(log_of(events))).select("seq", "url")


@query("fresh_answers", "events", "select event_id, ts >= timestamp '2024-01-30' - interval 5 day as fresh from events")
def fresh_answers(events: DataFrame) -> DataFrame:
    from corpusloom.operators import frontier

    return events.select("event_id", frontier.is_fresh(F.col("ts"), F.lit("2024-01-30").cast("timestamp"), 5 * 86400.0).alias("fresh"))


@query("dump_overview", "pages events", f"""select page_id, url, kind, recrawl, is_seed from (select page_id, url, page_id % 150 as u from pages) left join (select url as u, kind, recrawl, is_seed from {_FOLD}) using (u)""")
def dump_overview(pages: DataFrame, events: DataFrame) -> DataFrame:
    """Crawl results with their link states, if they have one."""
    states = state.fold(log_of(events)).select(F.col("url").alias("u"), "kind", "recrawl", "is_seed")
    return pages.select("page_id", "url", (F.col("page_id") % 150).alias("u")).join(states, "u", "left").drop("u")


@query("json_strings", "events", "select event_id, json_extract_string(props, '$.k') as k, list_sort(json_keys(props))[1] as first_key from events")
def json_strings(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.array_min(F.json_object_keys("props")).alias("first_key"))


@query("window_tumbling", "events", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def window_tumbling(events: DataFrame) -> DataFrame:
    rows = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("window_sliding", "events", "select s as start, count(*) as n, count(distinct user_id) as users from (select user_id, time_bucket(interval 30 minute, ts) - to_minutes(30 * i) as s from events, (select unnest([0, 1]) as i)) group by 1")
def window_sliding(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")).select(F.col("w.start").alias("start"), "n", "users")


@query("window_session", "events", """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as new from events),
    s as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from g)
    select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as n from s group by user_id, session""")
def window_session(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


@query("asof_last_error", "events", """select e.event_id, p.event_id as error_id from (select * from events where event_type = 'purchase') e asof left join (select user_id, ts, max(event_id) as event_id from events where event_type = 'error' group by 1, 2) p on e.user_id = p.user_id and e.ts >= p.ts""")
def asof_last_error(events: DataFrame) -> DataFrame:
    """The error before each purchase of a user: one pass over a window instead of a range join."""
    order = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "error", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    error = F.last(F.when(F.col("event_type") == "error", F.col("event_id")), ignorenulls=True).over(order)
    return events.filter("event_type in ('error', 'purchase')").withColumn("error_id", error).filter("event_type = 'purchase'").select("event_id", "error_id")


@query("event_ranks", "events", "select event_id, row_number() over w as rn, rank() over (partition by user_id order by event_type) as rk, dense_rank() over (partition by user_id order by event_type) as dr, ntile(4) over w as quarter, round(avg(value) over (w rows between 2 preceding and current row), 6) as moving from events window w as (partition by user_id order by ts, event_id)")
def event_ranks(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = Window.partitionBy("user_id").orderBy("event_type")
    big = lambda c: c.cast("bigint")
    return events.select("event_id", big(F.row_number().over(w)).alias("rn"), big(F.rank().over(t)).alias("rk"), big(F.dense_rank().over(t)).alias("dr"), big(F.ntile(4).over(w)).alias("quarter"), F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("moving"))


@query("user_sets", "events", """select 'both' as kind, user_id from (select user_id from events where event_type = 'purchase' intersect select user_id from events where event_type = 'error')
    union all select 'only', user_id from (select user_id from events where event_type = 'purchase' except select user_id from events where event_type = 'signup')
    union all select 'any', user_id from (select user_id from events where event_type = 'click' union select user_id from events where event_type = 'view')""")
def user_sets(events: DataFrame) -> DataFrame:
    of = lambda t: events.filter(F.col("event_type") == t).select("user_id")
    tag = lambda df, k: df.select(F.lit(k).alias("kind"), "user_id")
    return tag(of("purchase").intersect(of("error")), "both").union(tag(of("purchase").exceptAll(of("purchase").join(of("signup"), "user_id", "left_semi")).distinct(), "only")).union(tag(of("click").union(of("view")).distinct(), "any"))


@query("grouping_sets_events", "events", "select event_type, cast(ts as date) as day, count(*) as n, round(max(value), 6) as top from events group by grouping sets ((event_type), (cast(ts as date)), ())")
def grouping_sets_events(events: DataFrame) -> DataFrame:
    day = events.select("event_type", F.to_date("ts").alias("day"), "value")
    return day.groupingSets([["event_type"], ["day"], []], "event_type", "day").agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("top"))


@query("tpch_q1", "lineitem", """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n
    from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def tpch_q1(lineitem: DataFrame) -> DataFrame:
    kept = lineitem.filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return kept.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("tpch_q3", "customer orders lineitem", """select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, o_orderdate from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
    where c_mktsegment = 'BUILDING' group by 1, 3 order by revenue desc, l_orderkey limit 10""")
def tpch_q3(customer: DataFrame, orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    joined = customer.filter("c_mktsegment = 'BUILDING'").join(orders, F.col("c_custkey") == F.col("o_custkey")).join(lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    return joined.groupBy("l_orderkey", "o_orderdate").agg(revenue).orderBy(F.desc("revenue"), "l_orderkey").limit(10).select("l_orderkey", "revenue", "o_orderdate")


@query("tpch_q5", "customer orders lineitem supplier nation region", """select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
    join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1""")
def tpch_q5(customer, orders, lineitem, supplier, nation, region) -> DataFrame:
    joined = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("c_custkey") == F.col("o_custkey"))
    joined = joined.join(supplier, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("tpch_q6", "lineitem", "select round(sum(l_extendedprice * l_discount), 2) as revenue from lineitem where l_discount between 0.05 and 0.07 and l_quantity < 24")
def tpch_q6(lineitem: DataFrame) -> DataFrame:
    return lineitem.filter("l_discount between 0.05D and 0.07D and l_quantity < 24").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query("part_suppliers", "part lineitem", "select p_brand, count(distinct l_suppkey) as suppliers, count(*) as n from part join lineitem on p_partkey = l_partkey where p_size > 10 group by 1")
def part_suppliers(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    return part.filter("p_size > 10").join(lineitem, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.count("*").alias("n"))
