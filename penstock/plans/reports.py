"""Queues, funnels, rollups, joins and set operations of the reports as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import queues as Q
from ..operators.selection import best_by, top_by
from ..sources.readers import table
from .rates import REGISTRY

AS_OF = "1998-06-01"


def _registry(spark, d):
    return spark.sql(REGISTRY.replace("{text}", "string"), events=table(spark, d, "events"))


def rank_success(spark, d):
    """AGG-6, AGG-5, AGG-12, AGG-30: yields by rank and by length class, with averages."""
    r = _registry(spark, d).withColumn("rank", F.col("id") % 4 + 1).withColumn("length", F.when(F.col("text_length") < 2000, "short").when(F.col("text_length") < 8000, "medium").otherwise("long"))
    tried, ok = F.col("last_parse_result").isNotNull(), F.col("last_parse_result") == "success"
    return r.groupBy("rank", "length").agg(F.count_if(tried).alias("tried"), F.count_if(ok).alias("ok"), F.round(100 * F.count_if(ok) / F.nullif(F.count_if(tried), F.lit(0)), 1).alias("pct"), F.avg(F.when(tried, F.col("retry_count"))).alias("mean_retries"))


def status_report(spark, d):
    """AGG-11, AGG-8, FLT-15: one row of counters and a sorted list."""
    r = _registry(spark, d)
    return r.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pwsid").alias("n_keys"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("last_fetch_at").isNull() | (F.col("last_fetch_at") < F.lit("2024-01-15").cast("timestamp") - F.expr("interval 30 days"))).alias("cool"), F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("kinds"))


def violations(spark, d):
    """AGG-13, FLT-2: five-year rollup with the latest date of all years."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").cast("date").alias("begun"), F.when(F.col("o_orderstatus").isin("F", "P"), "Y").alias("health"))
    return Q.violation_rollup(o, as_of_year=2001, years=2).withColumn("latest", F.col("latest").cast("string"))


def gap_modes(spark, d):
    """AGG-22, AGG-26, SEL-14, JOIN-9: failure mode of keys by their longest text, with shares."""
    r = _registry(spark, d)
    stats = r.groupBy("pwsid").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("text_length") >= 5000).alias("with_text"), F.max("text_length").alias("longest"))
    best = best_by(r.filter("text_length >= 5000").select("pwsid", "id", "text_length", "last_parse_result", "event_type"), ["pwsid"], [-F.col("text_length"), F.col("id")])
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("pwsid"), F.col("c_acctbal").alias("pop"))
    rows = c.join(stats, "pwsid", "left").join(best.drop("text_length"), "pwsid", "left")
    notes = F.element_at(F.array(*[F.lit(x) for x in ("Please LOG IN", "click the link", "water/sewer", "")]), (F.col("pwsid") % 4 + 1).cast("int"))
    mode = Q.failure_mode(notes, F.col("total"), F.col("with_text"), F.col("last_parse_result"), F.when(F.col("pwsid") % 5 == 0, "low"), F.when(F.col("pwsid") % 3 == 0, "pdf").otherwise("html"), F.col("longest"))
    return Q.with_shares(rows.withColumn("mode", mode), "mode", "pop")


def status_crosstab(spark, d):
    """AGG-21: counts of status by kind with margins."""
    return Q.crosstab(_registry(spark, d), "event_type", "status", ["active", "dead", "pending"])


def amount_pivot(spark, d):
    """AGG-21: a pivot of sums with margins, absent pairs 0."""
    return Q.crosstab(table(spark, d, "orders").withColumn("year", F.year("o_orderdate").cast("string")), "year", "o_orderstatus", ["F", "O", "P"], F.col("o_custkey"))


def state_coverage(spark, d):
    """AGG-24, AGG-25, SORT-1: coverage of keys and population by nation, and as a whole."""
    c = table(spark, d, "customer").join(table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("has")).distinct(), "c_custkey", "left")
    has, pop = F.coalesce("has", F.lit(False)), F.floor(F.abs("c_acctbal"))
    by = Q.coverage_rollup(c, [F.col("c_nationkey").cast("string").alias("unit")], has, pop)
    lower = Q.coverage_rollup(c.filter("c_nationkey < 20"), [F.lit("lower").alias("unit")], has, pop)
    return by.unionByName(lower).unionByName(Q.coverage_rollup(c, [F.lit("all").alias("unit")], has, pop))


def latest_steps(spark, d):
    """AGG-27, FLT-11, API-8: the latest row of each step by a pair of columns."""
    e = table(spark, d, "events").select("event_type", "ts", "event_id")
    latest = e.groupBy("event_type").agg(F.max(F.struct("ts", "event_id")).alias("x"))
    return latest.select("event_type", "x.ts", "x.event_id")


def contaminated_urls(spark, d):
    """AGG-28, AGG-29, AGG-4: URLs under three keys or more, by host."""
    u = _registry(spark, d).filter("url like '%/%/%/%'").groupBy("url").agg(F.count_distinct("pwsid").alias("keys")).filter("keys >= 3")
    return u.groupBy(F.lower(F.parse_url("url", F.lit("HOST"))).alias("host")).agg(F.count(F.lit(1)).alias("urls"), F.sum("keys").alias("keys"))


def work_queue(spark, d):
    """SORT-2, FLT-13, JOIN-4: four queues with their own limits, by priority."""
    r = _registry(spark, d)
    row = lambda df, kind, priority: df.select(F.lit(kind).alias("task"), F.lit(priority).alias("priority"), "id", "pwsid")
    checks = r.filter("status = 'dead' and coalesce(last_parse_result, 'unknown') not in ('failed', 'success')").orderBy("id")
    gaps = r.filter("status = 'pending'").join(table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("pwsid")), "pwsid", "left_semi").orderBy(F.when(F.col("retry_count") == 0, 0).otherwise(1), "pwsid", "id")
    retries = r.filter("last_http_status >= 500").orderBy("retry_count", "id")
    changes = r.filter("status = 'active'").orderBy(F.asc("last_fetch_at"), "id")
    return Q.task_queue([(row(checks, "check", 0), 10), (row(gaps, "discover", 10), 50), (row(retries, "retry", 30), 20), (row(changes, "change", 50), 30)])


#: Coverage of customers for the agents' queue.
COVERAGE = """select c_custkey pwsid, c_nationkey state_code, c_custkey % 3 = 0 or c_nationkey % 2 = 0 has_rate_data, case c_custkey % 4 when 0 then 'url_discovered' when 1 then 'succeeded' else 'not_attempted' end scrape_status, case when c_custkey % 7 > 0 then cast(c_custkey % 5 as int) end priority_tier,
  case when c_custkey % 6 > 0 then cast('1998-06-01' as timestamp) - {days} end search_attempted_at, case when c_custkey % 11 > 0 then cast(floor(c_acctbal) as int) end population_served from {customer}"""


def agent_queue(spark, d):
    """SEL-11: what is to be done next: due sources, gaps, retries, addresses to be looked at again."""
    as_of = F.lit(AS_OF).cast("timestamp")
    catalog = table(spark, d, "nation").select(F.col("n_name").alias("source_key"), F.date_add(F.lit(AS_OF).cast("date"), (F.col("n_nationkey") - 12).cast("int")).alias("next_check_date"))
    coverage = spark.sql(COVERAGE.replace("{days}", "make_interval(0, 0, 0, cast(c_custkey % 60 as int))"), customer=table(spark, d, "customer"))
    r = _registry(spark, d)
    r = r.withColumn("retry_after", F.when(F.col("id") % 2 == 0, as_of - F.make_interval(days=(F.col("id") % 5).cast("int"))).otherwise(as_of + F.make_interval(days=F.lit(1)))).withColumn("status", F.when(F.col("id") % 6 == 2, "pending_retry").otherwise(F.col("status"))).withColumn("last_fetch_at", as_of - F.make_interval(days=(F.col("id") % 200).cast("int")))
    return Q.agent_queue(catalog, coverage, r, as_of, batch=60, days=90, changes=40)


def best_texts(spark, d):
    """SEL-19: the best text of a key that is its own, never parsed ones first."""
    r = _registry(spark, d).withColumn("content_len", F.when(F.col("id") % 9 > 0, F.col("text_length")))
    return Q.best_texts(r.select("id", "pwsid", "url", "last_parse_result", "content_len"), ["facebook.com", "/agenda/"])


def ranked_candidates(spark, d):
    """SEL-12, SORT-3: all candidates of a key, ranked by score."""
    r = _registry(spark, d)
    return Q.best_candidates(r, "pwsid", F.col("text_length") / 100, least=30, strategy="shotgun", then=[F.col("last_parse_result").isNotNull(), F.col("id")]).select("pwsid", "id", "score", "rank")


def discovery_funnel(spark, d):
    """SEL-22, SEL-6: distinct URLs of a key, their class, and the rank of those kept."""
    out = Q.funnel(_registry(spark, d), "pwsid", "url", F.col("text_length") / 100)
    return out.select("pwsid", "url", "score", "class", "rank")


def gap_triage(spark, d):
    """SEL-13, AGG-4: keys without an estimate in four classes, with the best URL that was not tried."""
    c = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("pwsid"), F.when(F.col("c_nationkey") % 2 == 0, "NY").otherwise("CO").alias("state_code"))
    r = _registry(spark, d).withColumn("url", F.when(F.col("pwsid") % 5 == 0, F.concat(F.lit("https://www.ny.gov/"), F.col("id"))).otherwise(F.col("url"))).withColumn("last_parse_result", F.when(F.col("pwsid") % 10 == 0, "failed").otherwise(F.col("last_parse_result")))
    return Q.gap_triage(c, r.withColumn("last_content_length", F.col("text_length")), ["facebook.com", "docs.example.com"], F.col("text_length"))


def parse_queue(spark, d):
    """SEL-18, TXT-15, FLT-14, FLT-8: unparsed texts of keys without an urgent order, longest first, with positional quantiles."""
    r = _registry(spark, d).filter("text_length between 3000 and 9000 and (last_parse_result is null or last_parse_result = 'failed')")
    r = r.join(table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("pwsid")), "pwsid", "left_anti")
    # positions in the running counts of lengths: a window over the distinct lengths only
    counts = r.groupBy("event_type", "text_length").agg(F.count(F.lit(1)).alias("k"))
    by = Window.partitionBy("event_type")
    counts = counts.withColumn("upto", F.sum("k").over(by.orderBy("text_length"))).withColumn("size", F.sum("k").over(by))
    at = lambda share: F.min(F.when(F.col("upto") > F.floor(F.col("size") * share), F.col("text_length")))
    return counts.groupBy("event_type").agg(F.sum("k").alias("n"), at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))


def retry_targets(spark, d):
    """SEL-20, SEL-23, SET-3: gap keys, then retry keys that are not among them."""
    r = _registry(spark, d)
    gap = r.filter("status = 'pending' and text_length > 9000").select("pwsid").distinct()
    return Q.missing_then_retry(gap, r.filter("last_http_status = 403 and text_length > 9000").select("pwsid"), "pwsid")


def labelled_union(spark, d):
    """SET-1, SET-2, FLT-6, FLT-7: a distinct union of three labelled sets by patterns."""
    r = _registry(spark, d)
    part = lambda df, label: df.select("pwsid", "url", F.lit(label).alias("label"))
    return part(r.filter(F.col("url").rlike("(?i)WATER-RATES")), "rates").union(part(r.filter("url ilike '%FEES' and url like 'https://w%'"), "fees")).union(part(r.filter(~F.col("url").rlike("(?i)(rates|fees|minutes)") & F.col("url").startswith("https://docs")), "docs")).distinct()


def year_chain(spark, d):
    """JOIN-7, MATH-15: three years of a key side by side, with changes within half."""
    y = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    of = lambda n: y.filter(F.col("y") == n).select("o_custkey", F.col("v").alias(f"v{n}"))
    j = of(1997).join(of(1998), "o_custkey").join(of(1999), "o_custkey")
    change = (F.col("v1999") - F.col("v1997")) / F.col("v1997") * 100
    return j.filter(F.abs(change) <= 50).select("o_custkey", "v1997", "v1998", "v1999", F.round(change, 1).alias("change"))


def latest_with_flags(spark, d):
    """JOIN-8, JOIN-10: the latest schedule of a key and whether it has others."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    latest = top_by(o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate"), ["c_custkey"], [F.desc_nulls_last("o_orderdate"), F.asc("o_orderkey")], 1)
    flag = o.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("__p")).distinct()
    return c.join(latest.drop("rank"), "c_custkey", "left").join(flag, "c_custkey", "left").select("c_custkey", "o_orderkey", F.col("__p").isNotNull().alias("has_pending"))


def flagged_join(spark, d):
    """JOIN-3: customers with their largest order, all of them or, as a flag asks, those that have one."""
    c = table(spark, d, "customer").select("c_custkey")
    top = best_by(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice"), ["c_custkey"], [-F.col("o_totalprice"), F.col("o_orderkey")])
    part = lambda flag: Q.joined(c, top, "c_custkey", only_matched=flag).select(F.lit(flag).alias("only_matched"), "c_custkey", "o_orderkey")
    return part(True).unionByName(part(False))


def one_row_report(spark, d):
    """JOIN-14, JOIN-15, SORT-5: optional parts on one row; a part without rows is null."""
    one = spark.range(1).drop("id")
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    rich = c.agg(F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("richest"))
    their = o.join(F.broadcast(rich), F.col("o_custkey") == F.col("richest")).agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("largest"))
    none = c.filter("c_acctbal > 1e12").select(F.col("c_name").alias("nobody")).limit(1)
    return one.join(rich, F.lit(True), "left").join(their, F.lit(True), "left").join(none, F.lit(True), "left")


def either_place(spark, d):
    """JOIN-16, SORT-4: rows that fit by one of two keys; of those by nation only the nearest balances below and above are candidates."""
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    rich = c.filter("c_mktsegment = 'BUILDING' and c_acctbal > 8000").groupBy(F.col("c_nationkey").alias("n"), F.col("c_acctbal").alias("bal")).agg(F.min("c_custkey").alias("c"))
    rows = rich.select("n", "bal", F.struct("c", "bal").alias("x"), F.lit(None).cast("long").alias("s")).unionByName(s.select(F.col("s_nationkey").alias("n"), F.col("s_acctbal").alias("bal"), F.lit(None).cast("struct<c:bigint,bal:double>").alias("x"), F.col("s_suppkey").alias("s")))
    by = Window.partitionBy("n")
    below, above = F.last("x", ignorenulls=True).over(by.orderBy("bal", F.asc_nulls_first("s"))), F.last("x", ignorenulls=True).over(by.orderBy(F.desc("bal"), F.asc_nulls_first("s")))
    near = rows.withColumn("y", F.array_compact(F.array(below, above))).filter("s is not null").select(F.col("s").alias("s_suppkey"), F.explode("y").alias("z"), "bal").select("s_suppkey", F.col("z.c").alias("c_custkey"), F.lit(0).alias("later"), F.abs(F.col("bal") - F.col("z.bal")).alias("apart"))
    own = s.join(c, F.col("s_suppkey") == F.col("c_custkey")).select("s_suppkey", "c_custkey", (F.col("c_mktsegment") != "BUILDING").cast("int").alias("later"), F.abs(F.col("s_acctbal") - F.col("c_acctbal")).alias("apart"))
    return best_by(near.unionByName(own), ["s_suppkey"], [F.col("later"), F.col("apart"), F.col("c_custkey")]).select("s_suppkey", "c_custkey")


def filtered_list(spark, d, segment=None, least=None, confidence="medium"):
    """FLT-3, FLT-4, FLT-5, FLT-10, SEL-17: optional conjuncts, a ladder of confidence, the largest first."""
    o = table(spark, d, "orders")
    ladder = {"high": ["1-URGENT"], "medium": ["1-URGENT", "2-HIGH"], "low": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}[confidence]
    o = o.filter(F.col("o_orderpriority").isin(ladder))
    o = o if segment is None else o.filter(F.col("o_orderstatus") == segment)
    o = o if least is None else o.filter(F.col("o_totalprice") >= least)
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice", "o_orderpriority")


def sharded_rows(spark, d):
    """FLT-16, FLT-9, FLT-12, FLT-1, FLT-17: shards by id, an existence within an aggregate, sentinels cleaned, columns that may be missing."""
    o = table(spark, d, "orders").withColumnsRenamed({"o_custkey": "key", "absent": "gone"})
    for c in ("review", "o_orderkey"):
        o = o if c in o.columns else o.withColumn(c, F.lit(None).cast("string"))
    clean = F.when(F.col("o_totalprice") < 400_000, F.col("o_totalprice")).alias("price")
    has = table(spark, d, "lineitem").filter("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("big")).distinct()
    o = o.join(has, "o_orderkey", "left").select("key", "big", "review", clean, F.pmod("o_orderkey", F.lit(4)).alias("shard"))
    return o.groupBy("shard").agg(F.count_if(F.col("big").isNotNull()).alias("with_big"), F.count("price").alias("n_price"), F.count_if(F.col("review").eqNullSafe(F.lit(None))).alias("unreviewed"))


def retry_states(spark, d):
    """SINK-15: the state of a URL after a failed fetch."""
    r = _registry(spark, d).filter("last_http_status >= 400")
    status, after = Q.retry_state(F.col("status"), F.col("last_http_status"), F.col("retry_count"), F.col("last_fetch_at"))
    return r.select("id", status.alias("status"), after.alias("retry_after"))


QUERIES = {f.__name__: f for f in (rank_success, status_report, violations, gap_modes, status_crosstab, amount_pivot, state_coverage, latest_steps, contaminated_urls, work_queue, agent_queue, best_texts, ranked_candidates, discovery_funnel, gap_triage, parse_queue, retry_targets, labelled_union, year_chain, latest_with_flags, flagged_join, one_row_report, either_place, filtered_list, sharded_rows, retry_states)}

_R = "with r as (" + REGISTRY.format(text="varchar", events="events") + ")"
_ROLL = "count(*) n, count(*) filter (has) n_covered, sum(p) pop, coalesce(sum(p) filter (has), 0) pop_covered, round(100 * count(*) filter (has) / count(*)::double, 1) pct, round(100 * coalesce(sum(p) filter (has), 0) / sum(p)::double, 1) pop_pct"
_MODE = """case when total is null then 'scrape_failed' when with_text > 0 and res is null then 'never_parsed' when k = 0 then 'auth_paywall' when with_text = 0 then 'scrape_failed' when longest < 200 and pwsid % 3 > 0 then 'js_wall'
    when k = 2 then 'water_sewer_combined' when k = 1 then 'rates_behind_link' when pwsid % 5 = 0 and res <> 'failed' then 'partial_extraction' when pwsid % 3 = 0 and res = 'failed' then 'pdf_extraction_failed' when res = 'failed' then 'wrong_url_all_ranks' else 'partial_extraction' end"""
ORACLE = {
    "rank_success": _R + """ select id % 4 + 1 as "rank", case when text_length < 2000 then 'short' when text_length < 8000 then 'medium' else 'long' end "length", count(last_parse_result) tried, count(*) filter (last_parse_result = 'success') ok, round(100 * count(*) filter (last_parse_result = 'success') / nullif(count(last_parse_result), 0)::double, 1) pct, avg(retry_count) filter (last_parse_result is not null) mean_retries from r group by 1, 2""",
    "status_report": _R + " select count(*) n, count(distinct pwsid) n_keys, sum((status = 'pending')::int)::bigint pending, sum((last_fetch_at is null or last_fetch_at < timestamp '2024-01-15' - interval 30 day)::int)::bigint cool, array_to_string(list_sort(list(distinct event_type)), '|') kinds from r",
    "violations": "with v as (select o_custkey \"key\", o_orderdate::date begun, o_orderstatus in ('F', 'P') h from orders), r as (select \"key\", count(*) violations, count(*) filter (h) health from v where year(begun) >= 1999 group by 1) select r.*, (select max(begun)::varchar from v where v.\"key\" = r.\"key\") latest from r",
    "gap_modes": _R + f""", s as (select pwsid, count(*) total, count(*) filter (text_length >= 5000) with_text, max(text_length) longest from r group by 1), b as (select distinct on (pwsid) pwsid, last_parse_result res from r where text_length >= 5000 order by pwsid, text_length desc, id),
        m as (select {_MODE} "mode", c_acctbal pop from (select c_custkey pwsid, c_custkey % 4 k, c_acctbal from customer) left join s using (pwsid) left join b using (pwsid))
        select "mode", count(*) n, sum(pop) total, round(100 * count(*) / sum(count(*)) over ()::double, 1) pct_count, round(100 * sum(pop) / sum(sum(pop)) over (), 1) pct_total from m group by 1""",
    "status_crosstab": _R + " select coalesce(event_type, 'All') event_type, count(*) filter (status = 'active') active, count(*) filter (status = 'dead') dead, count(*) filter (status = 'pending') pending, count(*) \"All\" from r group by rollup (event_type)",
    "amount_pivot": "with o as (select year(o_orderdate)::varchar y, o_orderstatus s, o_custkey v from orders) select coalesce(y, 'All') \"year\", coalesce(sum(v) filter (s = 'F'), 0)::bigint F, coalesce(sum(v) filter (s = 'O'), 0)::bigint O, coalesce(sum(v) filter (s = 'P'), 0)::bigint P, sum(v)::bigint \"All\" from o group by rollup (y)",
    "state_coverage": f"""with c as (select c_nationkey k, floor(abs(c_acctbal))::bigint p, exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT') has from customer), u as (select k::varchar unit, {_ROLL} from c group by 1 union all select 'lower', {_ROLL} from c where k < 20 union all select 'all', {_ROLL} from c)
        select unit, n, n_covered, pop::bigint pop, pop_covered::bigint pop_covered, pct, pop_pct from u""",
    "latest_steps": "select event_type, ts, max(event_id) event_id from events e where (event_type, ts) in (select event_type, max(ts) from events group by 1) group by 1, 2",
    "contaminated_urls": _R + ", u as (select url, count(distinct pwsid) k from r where url like '%/%/%/%' group by 1 having count(distinct pwsid) >= 3) select lower(regexp_extract(url, 'https://([^/]+)', 1)) host, count(*) urls, sum(k)::bigint \"keys\" from u group by 1",
    "work_queue": _R + """, a as (select 'check' task, 0 priority, id, pwsid from r where status = 'dead' and (last_parse_result is null or last_parse_result not in ('failed', 'success')) order by id limit 10),
        b as (select 'discover', 10, id, pwsid from r where status = 'pending' and pwsid in (select c_custkey from customer where c_acctbal > 5000) order by (retry_count > 0)::int, pwsid, id limit 50),
        c as (select 'retry', 30, id, pwsid from r where last_http_status >= 500 order by retry_count, id limit 20), e as (select 'change', 50, id, pwsid from r where status = 'active' order by last_fetch_at, id limit 30)
        select * from a union all select * from b union all select * from c union all select * from e""",
    "agent_queue": "with v as (" + COVERAGE.format(days="interval (c_custkey % 60) day", customer="customer") + "), r as (" + REGISTRY.format(text="varchar", events="events") + """), q as (select id, case when id % 6 = 2 then 'pending_retry' else status end status, case when id % 2 = 0 then timestamp '1998-06-01' - interval (id % 5) day else timestamp '1998-06-02' end retry_after, retry_count, timestamp '1998-06-01' - interval (id % 200) day last_fetch_at from r),
        gs as (select state_code from v group by 1 having round(100.0 * count(*) filter (has_rate_data) / count(*), 1) < 20),
        a as (select 'check_bulk_source' task, 0 priority, n_name \"key\" from nation where n_nationkey <= 12),
        b as (select 'discover_and_scrape', priority_tier * 10, pwsid::varchar from v where not has_rate_data and scrape_status in ('not_attempted', 'url_discovered') and priority_tier is not null and (search_attempted_at is null or search_attempted_at < timestamp '1998-06-01' - interval 30 day)
          and (population_served > 3000 or scrape_status = 'url_discovered') and (state_code in (from gs) or scrape_status = 'url_discovered') order by scrape_status <> 'url_discovered', priority_tier, population_served desc nulls last, pwsid limit 60),
        c as (select 'retry_scrape', 30, id::varchar from q where status = 'pending_retry' and retry_after <= timestamp '1998-06-01' order by retry_count, id limit 20), e as (select 'change_detection', 50, id::varchar from q where status = 'active' and last_fetch_at < timestamp '1998-06-01' - interval 90 day order by last_fetch_at, id limit 40)
        select * from a union all select * from b union all select * from c union all select * from e""".replace('\\"', '"'),
    "best_texts": _R + """ select pwsid, id, url, last_parse_result, case when id % 9 > 0 then text_length end content_len from r where lower(url) not like '%facebook.com%' and lower(url) not like '%/agenda/%'
        qualify row_number() over (partition by pwsid order by last_parse_result is not null, coalesce(case when id % 9 > 0 then text_length end, 0) desc, id) = 1""",
    "ranked_candidates": _R + " select pwsid, id, text_length / 100::double score, row_number() over (partition by pwsid order by text_length desc, last_parse_result is not null, id)::int \"rank\" from r where text_length >= 3000",
    "discovery_funnel": _R + """, u as (select pwsid, url, max(text_length) / 100::double score from r group by 1, 2), k as (select *, case when score > 30 then 'kept' when score >= 15 then 'near_miss' else 'below' end "class" from u)
        select *, row_number() over (partition by pwsid order by score desc, url)::int "rank" from k where "class" = 'kept' qualify "rank" <= 5 union all select *, null from k where "class" <> 'kept'""",
    "gap_triage": _R + """, g as (select c_custkey pwsid, case when c_nationkey % 2 = 0 then 'NY' else 'CO' end state from customer where c_acctbal > 0), q as (select pwsid, id, case when pwsid % 5 = 0 then 'https://www.ny.gov/' || id else url end url, case when pwsid % 10 = 0 then 'failed' else last_parse_result end res, text_length n from r where text_length >= 200 and status <> 'dead'),
        h as (select *, url like 'https://facebook.com%' or url like 'https://docs.example.com%' bad from q), k as (select pwsid, bool_and(bad) allbad, bool_and(url like 'https://www.ny.gov/%') portal from h group by 1), b as (select pwsid, id, url from h where res is null and not bad qualify row_number() over (partition by pwsid order by n desc, id) = 1)
        select pwsid, case when k.pwsid is null then 'exhausted' when b.id is not null then 'submittable' when allbad then 'blacklisted_only' when state = 'NY' and portal then 'ny_portal_only' else 'exhausted' end "class", case when k.pwsid is null then 'no_text_available' when b.id is not null then null when allbad then 'all_urls_blacklisted' when state = 'NY' and portal then 'ny_portal_only' else 'all_ranks_tried' end reason, b.id, b.url from g left join k using (pwsid) left join b using (pwsid)""",
    "parse_queue": _R + """, q as (select * from r where text_length between 3000 and 9000 and coalesce(last_parse_result, 'failed') = 'failed' and not exists (select 1 from orders where o_custkey = pwsid and o_orderpriority = '1-URGENT')), l as (select event_type, list(text_length order by text_length) x from q group by 1)
        select event_type, len(x) n, x[len(x) // 4 + 1] q1, x[len(x) // 2 + 1] q2, x[(3 * len(x)) // 4 + 1] q3 from l""",
    "retry_targets": _R + ", g as (select distinct pwsid from r where status = 'pending' and text_length > 9000) select pwsid, 'gap' reason from g union all select pwsid, 'retry' from r where last_http_status = 403 and text_length > 9000 and pwsid not in (select pwsid from g)",
    "labelled_union": _R + " select pwsid, url, 'rates' label from r where url like '%water-rates%' union select pwsid, url, 'fees' from r where url like '%/Fees' and url like 'https://w%' union select pwsid, url, 'docs' from r where lower(url) not like '%rates%' and lower(url) not like '%fees%' and lower(url) not like '%minutes%' and url like 'https://docs%'",
    "year_chain": "with y as (select o_custkey, round(sum(o_totalprice) filter (year(o_orderdate) = 1997), 2) v1997, round(sum(o_totalprice) filter (year(o_orderdate) = 1998), 2) v1998, round(sum(o_totalprice) filter (year(o_orderdate) = 1999), 2) v1999 from orders group by 1) select *, round((v1999 - v1997) / v1997 * 100, 1) \"change\" from y where v1998 is not null and abs((v1999 - v1997) / v1997 * 100) <= 50",
    "latest_with_flags": "select c_custkey, l.o_orderkey, exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') has_pending from customer left join lateral (select o_orderkey from orders where o_custkey = c_custkey order by o_orderdate desc, o_orderkey limit 1) l on true",
    "flagged_join": """with t as (select c_custkey, o_orderkey from customer left join orders on o_custkey = c_custkey qualify row_number() over (partition by c_custkey order by o_totalprice desc, o_orderkey) = 1)
        select true only_matched, * from t where o_orderkey is not null union all select false, * from t""",
    "one_row_report": "with r as (select c_custkey from customer order by c_acctbal desc, c_custkey limit 1) select (select c_custkey from r) richest, (select count(*) from orders where o_custkey = (select c_custkey from r)) n_orders, (select max(o_totalprice) from orders where o_custkey = (select c_custkey from r)) largest, null::varchar nobody",
    "either_place": "select s_suppkey, c_custkey from supplier join customer on (s_nationkey = c_nationkey and c_mktsegment = 'BUILDING' and c_acctbal > 8000) or s_suppkey = c_custkey qualify row_number() over (partition by s_suppkey order by (c_mktsegment = 'BUILDING') desc, abs(s_acctbal - c_acctbal), c_custkey) = 1",
    "filtered_list": "select o_orderkey, o_totalprice, o_orderpriority from orders where o_orderpriority in ('1-URGENT', '2-HIGH') order by o_totalprice desc, o_orderkey limit 50",
    "sharded_rows": "select o_orderkey % 4 shard, count(*) filter (exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity >= 50)) with_big, count(*) filter (o_totalprice < 400000) n_price, count(*) unreviewed from orders group by 1",
    "retry_states": _R + """ select id, case when last_http_status = 404 or (last_http_status = 403 and retry_count >= 5) then 'dead' else 'pending_retry' end status,
        case when last_http_status = 404 or (last_http_status = 403 and retry_count >= 5) then null when last_http_status = 403 then date_trunc('second', last_fetch_at) + to_days(least(2 ** (retry_count + 1), 30)::int) else date_trunc('second', last_fetch_at) + interval 6 hour end retry_after from r where last_http_status >= 400""",
}
