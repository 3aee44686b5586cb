"""The public rate queries, downloads and reports over schedules made from orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import tables as T
from ..operators.selection import best_estimate, top_by
from ..sources.readers import table
from .rates import RATES, _rates

LADDER = {"high": ["high"], "medium": ["high", "medium"], "low": ["high", "medium", "low"]}


def _boundaries(spark, d):
    """A key a customer with name, state, population and a point."""
    state = F.when(F.col("c_custkey") % 3 == 0, "CA").when(F.col("c_custkey") % 3 == 1, "NC").otherwise("VA")
    return table(spark, d, "customer").select(F.concat(state, F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("pwsid"), F.col("c_name").alias("pws_name"), state.alias("state"), F.floor(F.abs("c_acctbal")).alias("population"), (F.col("c_custkey") % 360 - 180).cast("double").alias("lng"), (F.col("c_custkey") % 170 - 85).cast("double").alias("lat"))


def estimates(spark, d, state="CA", least_confidence="medium", low=30.0, high=120.0):
    """API-4: best estimates by state, confidence and bill, the largest systems first."""
    e = best_estimate(_rates(spark, d)).filter(F.col("confidence").isin(LADDER[least_confidence]))
    e = e if state is None else e.filter(F.col("state_code") == state)
    e = e.filter(F.col("bill_estimate_10ccf").between(low, high)).join(_boundaries(spark, d).select("pwsid", "pws_name", "population"), "pwsid", "left")
    return e.orderBy(F.desc_nulls_last("population"), "pwsid").limit(100).select("pwsid", "pws_name", "population", "bill_estimate_10ccf", "confidence")


def latest_schedules(spark, d):
    """API-5, API-10: the latest schedule of high or medium confidence of each key."""
    r = _rates(spark, d).filter(F.col("confidence").isin(LADDER["medium"]))
    return top_by(r, ["pwsid"], [F.desc_nulls_last("vintage_date"), F.asc("id")], 1).select("pwsid", "id", "source", "bill_10ccf", F.col("vintage_date").cast("string").alias("vintage_date"))


def rate_list(spark, d):
    """API-6, NEST-1: schedules with names and population, largest first."""
    r = _rates(spark, d).filter(F.col("confidence").isin(LADDER["high"]))
    charges = F.from_json(F.format_string('[{"name":"Service Charge","amount":%s}]', F.col("fixed").cast("string")), "array<struct<name:string,amount:double>>")
    out = r.withColumn("charge", charges[0]["amount"]).join(_boundaries(spark, d).select("pwsid", "pws_name", "population"), "pwsid", "left")
    return out.orderBy(F.desc_nulls_last("population"), "id").select("id", "pwsid", "pws_name", "population", "charge", "bill_10ccf").limit(200)


def bulk_download(spark, d):
    """API-7, JOIN-2, GEO-5, SINK-11: boundaries with estimates, and each as a feature."""
    e = best_estimate(_rates(spark, d)).select("pwsid", "bill_estimate_10ccf", "confidence")
    out = _boundaries(spark, d).join(e, "pwsid", "left").filter("population > 9000")
    return out.select("pwsid", "bill_estimate_10ccf", "confidence", G.feature(["pwsid", "population"], F.col("lng"), F.col("lat")).alias("feature"))


def key_quota(spark, d):
    """API-9: requests of a day in order, and whether the key's daily quota lets each through."""
    tier = F.when(F.col("user_id") % 3 == 0, 2).when(F.col("user_id") % 3 == 1, 3).otherwise(5)
    order = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("nth", F.row_number().over(order))
    return e.select("event_id", F.sha2(F.concat(F.lit("key-"), F.col("user_id").cast("string")), 256).alias("key_hash"), (F.col("nth") <= tier).alias("allowed"))


def county_json(spark, d):
    """SINK-12: the keys of a state and county as a sorted array."""
    b = _boundaries(spark, d).withColumn("county", F.concat("state", F.lit(":County"), (F.col("population") % 7).cast("string")))
    return b.groupBy("county").agg(F.to_json(F.sort_array(F.collect_list(F.struct("pwsid", "population")))).alias("members"))


def conditional_upsert(spark, d):
    """SINK-3, SINK-5, SINK-9, FLT-12: new rows replace old ones, the last of a key wins, notes stay where none came."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("notes"))
    n = table(spark, d, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("name"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("new")).alias("notes"), "o_orderkey")
    return T.upsert(c, n, ["k"], keep_where_null=["notes"], last_by=F.col("o_orderkey"))


def key_checked_insert(spark, d):
    """SINK-8: rows whose key is unknown are left out and counted."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 2000).alias("k"))
    kept, skipped = T.with_known_key(o, table(spark, d, "customer").select(F.col("c_custkey").alias("k")).filter("k % 10 > 0"), "k")
    return kept.agg(F.count(F.lit(1)).alias("kept")).join(F.broadcast(skipped.agg(F.count(F.lit(1)).alias("skipped"))))


QUERIES = {f.__name__: f for f in (estimates, latest_schedules, rate_list, bulk_download, key_quota, county_json, conditional_upsert, key_checked_insert)}

from .rates import ORACLE as _RATES_ORACLE  # noqa: E402

_R = "with r as (" + RATES.format(text="varchar", orders="orders") + ")"
_E = "e as (" + _RATES_ORACLE["best_estimate"] + ")"
_B = "b as (select case c_custkey % 3 when 0 then 'CA' when 1 then 'NC' else 'VA' end || lpad(c_custkey::varchar, 7, '0') pwsid, c_name pws_name, case c_custkey % 3 when 0 then 'CA' when 1 then 'NC' else 'VA' end state, floor(abs(c_acctbal))::bigint population, c_custkey % 360 - 180 lng, c_custkey % 170 - 85 lat from customer)"
ORACLE = {
    "estimates": f"with {_E}, {_B} select pwsid, pws_name, population, bill_estimate_10ccf, confidence from e left join b using (pwsid) where state_code = 'CA' and confidence in ('high', 'medium') and bill_estimate_10ccf >= 30 and bill_estimate_10ccf <= 120 order by population desc, pwsid limit 100",
    "latest_schedules": _R + " select pwsid, id, source, bill_10ccf, vintage_date::varchar vintage_date from r where confidence in ('high', 'medium') qualify row_number() over (partition by pwsid order by r.vintage_date desc nulls last, id) = 1",
    "rate_list": _R + f", {_B} select id, pwsid, pws_name, population, fixed charge, bill_10ccf from r left join b using (pwsid) where confidence = 'high' order by population desc, id limit 200",
    "bulk_download": f"""with {_E}, {_B} select pwsid, bill_estimate_10ccf, e.confidence, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || lng::double || ',' || lat::double || ']}},"properties":{{"pwsid":"' || pwsid || '","population":' || population || '}}}}' feature from b left join e using (pwsid) where population > 9000""",
    "key_quota": "select event_id, sha256('key-' || user_id) key_hash, row_number() over (partition by user_id, ts::date order by ts, event_id) <= case user_id % 3 when 0 then 2 when 1 then 3 else 5 end allowed from events",
    "county_json": f"""with {_B} select state || ':County' || population % 7 county, '[' || string_agg('{{"pwsid":"' || pwsid || '","population":' || population || '}}', ',' order by pwsid) || ']' members from b group by 1""",
    "conditional_upsert": """with n as (select distinct on (o_custkey) o_custkey k, case when o_orderkey % 3 > 0 then o_orderpriority end name, case when o_orderkey % 2 = 0 then 'new' end notes, true came from orders where o_orderkey % 5 = 0 order by o_custkey, o_orderkey desc)
        select coalesce(n.k, c_custkey) k, case when came then n.name else c_name end name, coalesce(n.notes, 'n' || c_custkey) notes from customer full join n on n.k = c_custkey""",
    "key_checked_insert": "select count(*) filter (ok) kept, count(*) filter (not ok) skipped from (select exists (select 1 from customer where c_custkey = o_custkey % 2000 and c_custkey % 10 > 0) ok from orders)",
}
