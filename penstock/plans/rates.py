"""Selection, status, reconciliation and quality as queries over schedules made from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import quality as Q
from ..operators import reconcile as R
from ..operators import selection as S
from ..sources.readers import table

#: Schedules: a key a customer, one of eight sources an order, bills at several volumes.
RATES = """select o_orderkey id, case o_custkey % 3 when 0 then 'CA' when 1 then 'NC' else 'VA' end || lpad(cast(o_custkey as {text}), 7, '0') pwsid, case o_custkey % 3 when 0 then 'CA' when 1 then 'NC' else 'VA' end state_code,
  case o_orderkey % 8 when 0 then 'scraped_llm' when 1 then 'swrcb_ear_2022' when 2 then 'swrcb_ear_2021' when 3 then 'efc_nc_2025' when 4 then 'owrs' when 5 then 'efc_zz_2020' when 6 then 'scraped_llm' else 'other' end source,
  case when o_orderkey % 5 > 1 then 15 + o_orderkey * 7 % 120 end::double bill_10ccf, case when o_orderkey % 5 = 0 then 20 + o_orderkey % 30 end::double bill_9ccf,
  case when o_orderkey % 10 = 0 then 23 + o_orderkey % 30 + 3 * (o_orderkey % 7) when o_orderkey % 15 = 5 then 26 + o_orderkey % 30 end::double bill_12ccf, case when o_orderkey % 15 = 1 then 30 end::double bill_6ccf,
  case when o_orderkey % 5 > 2 then 40 + o_orderkey * 11 % 160 when o_orderkey % 5 > 1 then 15 + o_orderkey * 7 % 120 end::double bill_20ccf,
  case o_orderkey % 7 when 0 then 'low' when 1 then 'high' when 2 then 'medium' when 3 then 'failed' end confidence, case when o_orderkey % 6 > 0 then cast(o_orderdate as date) end vintage_date,
  case o_orderkey % 4 when 0 then 'flat' when 1 then 'uniform' when 2 then 'increasing_block' end structure, o_totalprice / 4 top_limit, o_orderkey % 250 - 20.0::double fixed from {orders}"""


def _rates(spark, d):
    return spark.sql(RATES.replace("{text}", "string"), orders=table(spark, d, "orders"))


def _scored(spark, d):
    r = _rates(spark, d)
    bill = S.comparable_bill(F.col("bill_10ccf"), F.col("bill_9ccf"), F.col("bill_12ccf"))
    r = r.withColumn("bill", bill).withColumn("vintage", F.col("vintage_date"))
    return r.withColumn("flags", Q.record_flags(F.col("source"), {"tier_1_limit_ccf": F.col("top_limit") / 3, "tier_2_limit_ccf": F.col("top_limit")}, F.col("bill"), F.col("fixed"), F.col("vintage"), suspect_limit=60_000.0, low=20.0, high=120.0, stale_year=1997))


#: Published sources, and some that only a prefix or nothing fits.
SOURCES = [*S.PUBLISHED.exact, "efc_zz_2030", "swrcb_x", "tx_other", "efcx"]


def best_estimate(spark, d):
    """SEL-1, SEL-2, SEL-4, AGG-14: one estimate a key."""
    r = _rates(spark, d).withColumnsRenamed({"structure": "rate_structure_type", "fixed": "fixed_charge_monthly"}).withColumn("utility_name", F.concat(F.lit("Works "), F.col("pwsid")))
    return S.best_estimate(r).withColumn("vintage_date", F.col("vintage_date").cast("string"))


def anchored_estimate(spark, d):
    """A candidate against an anchor."""
    return S.anchored_estimate(_rates(spark, d), "swrcb_ear_2022", "scraped_llm")


def older_estimate(spark, d):
    """SEL-5: the older selector, with priorities, anchor, confidence and notes."""
    return S.older_estimate(_rates(spark, d)).withColumn("vintage_date", F.col("vintage_date").cast("string"))


def guessed_urls(spark, d):
    """SEL-21: the best guessed address of a key, without those that lead elsewhere."""
    return S.best_guess(spark.sql(GUESSES.replace("{text}", "string"), events=table(spark, d, "events")).withColumnRenamed("dom", "domain"), X.host)


def source_tiers(spark, d):
    """SEL-2, SEL-3: priority and tier of every published source and of others, and the way to its comparable bill."""
    c = S.PUBLISHED
    names = F.array(*[F.lit(n) for n in SOURCES])
    r = _rates(spark, d).withColumn("source", F.get(names, (F.col("id") % len(SOURCES)).cast("int")))
    return r.select("id", "source", S.priority_of(F.col("source"), c.exact, c.prefixes, c.fallback).alias("priority"), S.resolve(F.col("source"), c.tiers, c.prefix_tiers, c.fallback_tier).alias("tier"), S.comparable_method(F.col("bill_10ccf"), F.col("bill_9ccf"), F.col("bill_12ccf")).alias("way"))


def coverage(spark, d):
    """SEL-15, SEL-16, SINK-7, SINK-9: rate and status columns of every key."""
    spine = table(spark, d, "customer").select(F.col("c_custkey").alias("pwsid"), F.when(F.col("c_custkey") % 3 == 0, "succeeded").otherwise("not_attempted").alias("scrape_status"), F.col("c_acctbal").alias("population"))
    registry = spark.sql(REGISTRY.replace("{text}", "string"), events=table(spark, d, "events"))
    status = S.scrape_status(registry, spine)
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("sources"), F.count_distinct("o_orderpriority").alias("n_sources"), F.max("o_orderdate").alias("latest"))
    out = status.join(o, F.col("pwsid") == F.col("k"), "left")
    return out.select("pwsid", "scrape_status", F.col("k").isNotNull().alias("has_rate_data"), "sources", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), "latest")


#: Registry rows made from events.
REGISTRY = """select user_id pwsid, event_id id, 'https://' || case event_id % 5 when 0 then 'www.clearlake.ca.gov' when 1 then 'Water.Example.ORG' when 2 then 'ci.springfield.us' when 3 then 'facebook.com' else 'docs.example.com' end
  || case event_id % 4 when 0 then '/utilities/water-rates.pdf' when 1 then '/departments/' || cast(event_id % 7 as {text}) || '/Fees' when 2 then '/agenda/2019/minutes?id=' || cast(event_id % 11 as {text}) else '' end url,
  case when event_id % 3 = 0 then 'pending' when event_id % 3 = 1 then 'active' else 'dead' end status, case when event_id % 17 = 1 then 'success' when event_id % 4 = 1 then 'failed' end last_parse_result,
  case when event_id % 3 <> 0 then ts end last_fetch_at, case when event_id % 5 > 1 then case event_id % 4 when 0 then 200 when 1 then 403 when 2 then 404 else 503 end end last_http_status, cast(event_id % 8 as int) retry_count, cast(floor(value * 100) as int) text_length, event_type from {events}"""


def variance(spark, d):
    """AGG-15, AGG-16, AGG-17, DATE-4: spread, causes and class of keys with several sources."""
    return R.variance(_scored(spark, d))


def cause_counts(spark, d):
    """AGG-20: how often each cause is named among the divergent keys."""
    v = R.variance(_scored(spark, d)).filter("cv_pct > 25 and divergence_causes <> 'within_tolerance'")
    return R.tag_counts(v, F.split("divergence_causes", "; "))


def combined_suspects(spark, d):
    """AGG-23: scrapes that look like two bills in one."""
    return R.combined_suspects(_scored(spark, d))


def overlap_by_state(spark, d):
    """JOIN-6, AGG-10, AGG-18, AGG-19: agreement of two sources by state."""
    pairs = R.overlap(_scored(spark, d), F.col("source").startswith("efc_"), F.col("source") == "scraped_llm")
    return R.agreement_report(pairs.withColumn("state", F.left("pwsid", F.lit(2))), "state")


def year_gaps(spark, d):
    """AGG-19, AGG-10, AGG-4, DATE-4: differences of bills by the gap of years, groups of two or more."""
    r = _scored(spark, d).filter("bill is not null and vintage is not null")
    side = lambda s, n: r.filter(F.col("source") == s).groupBy("pwsid").agg(F.min_by(F.struct("bill", "vintage"), "id").alias(n))
    both = side("efc_nc_2025", "a").join(side("scraped_llm", "b"), "pwsid")
    diff = F.abs((F.col("b.bill") - F.col("a.bill")) / F.col("a.bill") * 100)
    g = both.groupBy((F.year("b.vintage") - F.year("a.vintage")).alias("gap")).agg(F.count(F.lit(1)).alias("n"), F.percentile(diff, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.9))).alias("q"), F.stddev_samp(diff).alias("sd"))
    return g.filter("n >= 2").select("gap", "n", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"), "sd")


def runs_compared(spark, d):
    """AGG-31: lengths of texts before and after a second run."""
    r = _rates(spark, d).select("id", F.when(F.col("id") % 9 > 0, F.col("id") % 700).alias("length"))
    after = r.filter("id % 7 > 0").select("id", F.when(F.col("id") % 4 == 0, F.col("length") * 3).when(F.col("id") % 4 == 1, F.col("length") + 400).when(F.col("id") % 4 == 2, F.col("length") - 5).alias("length"))
    return R.compare_runs(r, after, "id", "length")


def source_parity(spark, d):
    """AGG-32, JOIN-21: rows and keys by source of two versions of a table."""
    r = _rates(spark, d)
    return R.parity(r.filter("source <> 'owrs'"), r.filter("id % 3 > 0 and source <> 'other'"), "source", "pwsid")


def disagreements(spark, d):
    """AGG-33: classes of gross errors of one side against the other."""
    i = F.col("id")
    a = F.when(i % 11 == 0, None).when(i % 13 == 0, F.lit(0.0)).when(i % 17 == 0, F.lit(600.0)).when(i % 5 == 2, F.col("bill_10ccf") * 6).otherwise(F.col("bill_20ccf"))
    return R.error_classes(_rates(spark, d).select(a.alias("a"), F.col("bill_10ccf").alias("b"), F.when(i % 3 > 0, F.col("bill_10ccf") / 2).alias("b5"), F.col("bill_20ccf").alias("b20"), "structure"))


def record_checks(spark, d):
    """QC-1, QC-2, QC-3, QC-4, QC-6: flags, issues, grades of each schedule."""
    s = _scored(spark, d)
    n = (F.col("id") % 4).cast("int")
    issues = Q.parse_issues([F.when(n > 0, F.col("fixed") / 4), F.when(n > 1, F.col("fixed") / 2)], F.col("fixed") * 3, F.col("confidence"))
    shown = Q.display_flags(F.col("vintage"), F.col("bill_9ccf"), F.col("bill_12ccf"), 1999)
    return s.select("id", F.array_join("flags", "; ").alias("flags"), F.array_join(issues, "; ").alias("issues"), Q.identical_bills(F.col("bill_10ccf"), F.col("bill_10ccf"), F.col("bill_20ccf"), F.col("structure")).alias("identical"), Q.grade(F.col("bill_10ccf"), n).alias("grade"), shown["stale"].alias("stale"), shown["high_variance"].alias("high_variance"))


def bias_by_group(spark, d):
    """QC-5: groups in which scraped bills differ from a survey's in one direction."""
    r = _scored(spark, d).filter("bill is not null")
    side = lambda c, n: r.filter(c).groupBy("pwsid").agg(F.min_by("bill", "id").alias(n))
    pairs = side("source like 'efc_%'", "a").join(side("source = 'scraped_llm'", "b"), "pwsid")
    return R.group_bias(pairs.withColumn("grp", F.substring("pwsid", 8, 2)), "grp")


def issue_audit(spark, d):
    """QC-5: issues by state: missing and identical bills, outliers by the deviation from the state's mean, stale vintages."""
    r = _rates(spark, d)
    mean = r.groupBy("state_code").agg(F.avg("bill_10ccf").alias("m"), F.stddev_samp("bill_10ccf").alias("s"))
    r = r.join(mean, "state_code")
    return r.groupBy("state_code").agg(F.count_if(F.coalesce("bill_10ccf", F.lit(0.0)) == 0).alias("missing"), F.count_if(Q.identical_bills(F.col("bill_10ccf"), F.col("bill_10ccf"), F.col("bill_20ccf"), F.col("structure"))).alias("identical"), F.count_if(F.abs(F.col("bill_10ccf") - F.col("m")) > 1.5 * F.col("s")).alias("outliers"), F.count_if(F.year("vintage_date") < 1997).alias("stale"))


def complete_rows(spark, d):
    """SEL-6, SEL-7, SEL-8, SEL-9, SEL-10: one row a key by completeness, a category by rank, a meter by size."""
    r = _rates(spark, d)
    best = S.most_complete(r.select("pwsid", "id", "bill_10ccf", "bill_9ccf", "bill_12ccf", "confidence", "vintage_date"), ["pwsid"], ["bill_10ccf", "bill_9ccf", "bill_12ccf"], [F.coalesce(F.datediff(F.lit("9999-12-31"), "vintage_date"), F.lit(1 << 30)), F.col("id")])
    kinds = r.groupBy("pwsid").agg(F.collect_set("structure").alias("kinds"), F.sort_array(F.collect_list(F.struct("id", (F.col("id") % 6 / 8.0).alias("size"), F.col("fixed").alias("amount")))).alias("meters"))
    kinds = kinds.withColumn("meter", S.meter_row(F.transform("meters", lambda m: F.struct(m["size"].alias("size"), m["amount"].alias("amount"))), 0.625))
    return best.join(kinds, "pwsid").select("pwsid", "id", S.highest_category(F.col("kinds"), ["increasing_block", "uniform", "flat"]).alias("category"), F.col("meter.size").alias("meter_size"))


#: Guessed addresses: a user's, with the place that they lead to.
GUESSES = """select event_id id, user_id pwsid, case when event_id % 9 = 0 then '' else 'https://www.' || g || '/' || cast(event_id % 3 as {text}) end guessed_url, case event_id % 4 when 0 then null when 1 then 'https://' || g || '/rates' when 2 then 'https://www.parked.com/x' else 'https://utility.clearlake.ca.gov/w' end final_url,
  g dom, case when event_id % 50 = 7 then 'name_water' when event_id % 3 = 0 then 'gov' end confidence_tier, cast(event_id % 13 as int) confidence_score from (select *, case event_id % 5 when 0 then 'clearlake.gov' when 1 then 'clearlake.com' when 2 then 'oz.org' when 3 then 'parked.org' else 'lake.us' end g from {events}) t"""
QUERIES = {f.__name__: f for f in (best_estimate, older_estimate, guessed_urls, anchored_estimate, source_tiers, coverage, variance, cause_counts, combined_suspects, overlap_by_state, year_gaps, runs_compared, source_parity, disagreements, record_checks, bias_by_group, issue_audit, complete_rows)}

_R = "with r as (" + RATES.format(text="varchar", orders="orders") + ")"
_B = "case when bill_10ccf > 0 then bill_10ccf when bill_9ccf > 0 and bill_12ccf > 0 then round(bill_9ccf + (bill_12ccf - bill_9ccf) / 3, 2) when bill_12ccf > 0 then bill_12ccf end"
_S = _R + f""", s as (select *, {_B} bill, vintage_date vintage from r),
    f as (select *, source like '%ear%' and top_limit > 60000 ear, coalesce(bill > 120, false) hi, coalesce(bill < 20, false) lo, coalesce(year(vintage) < 1997, false) old, fixed > 200 fh, fixed < 0 fn from s)"""
_V = _S + """, g as (select pwsid, count(*) n_records, avg(bill) mean, min(bill) lo_, max(bill) hi_, stddev_pop(bill) sd, string_agg(distinct source, ', ' order by source) sources, count(distinct source) n_sources, bool_or(ear or hi or lo or old or fh or fn) flagged,
      bool_or(ear) ear, bool_or(hi) hi, bool_or(old) old, bool_or(lo) lo, date_diff('day', min(vintage), max(vintage)) / 365.25::double yrs from f where bill is not null group by pwsid having count(distinct source) > 1),
    c as (select *, round(sd / mean * 100, 1) cv, concat_ws('; ', case when ear then 'eAR_tier_inflation' end, case when hi then 'possible_combined_charges' end, case when old then 'stale_vintage' end, case when lo then 'data_quality_low' end, case when yrs > 3 then format('vintage_gap_{:.0f}yr', yrs) end) causes from g),
    v as (select pwsid, n_sources::int n_sources, sources, n_records, round(mean, 2) mean_bill, round(lo_, 2) min_bill, round(hi_, 2) max_bill, round(hi_ - lo_, 2) spread, cv cv_pct, flagged has_quality_flags, case when causes <> '' then causes when sd / mean * 100 > 25 then 'unexplained' else 'within_tolerance' end divergence_causes,
      case when cv > 100 then '>100% conflict' when cv > 50 then '50-100% major' when cv > 25 then '25-50% divergent' when cv > 10 then '10-25% moderate' when cv > 0 then '<10% agree' end "class" from c)"""
_P = "case source when 'scraped_llm' then 1 when 'swrcb_ear_2022' then 3 when 'swrcb_ear_2021' then 4 when 'efc_nc_2025' then 3 else case when starts_with(source, 'efc_') then 3 else 5 end end"

ORACLE = {
    "best_estimate": _R + f""", s as (select *, coalesce({_B}, case when bill_6ccf > 0 then bill_6ccf end) comp, case when source = 'scraped_llm' and confidence = 'low' then 6 else {_P} end p from r),
        b as (select * from s where comp is not null qualify row_number() over (partition by pwsid order by p, source, vintage_date desc nulls last, id) = 1),
        a as (select pwsid, source a_source, comp a_bill from s where comp is not null and state_code = 'CA' and source in ('swrcb_ear_2022', 'swrcb_ear_2021') qualify row_number() over (partition by pwsid order by case source when 'swrcb_ear_2022' then 0 else 1 end, id) = 1),
        k as (select pwsid, any_value(state_code) state_code, count(distinct source)::int n_sources from r group by pwsid)
        select k.pwsid, k.state_code, b.source selected_source, round(b.comp, 2) bill_estimate_10ccf, b.bill_10ccf, b.bill_6ccf, b.bill_12ccf, b.vintage_date::varchar vintage_date, n_sources, a_source anchor_source, a_bill anchor_bill,
        case when b.comp is null then 'none' when b.source like 'swrcb_ear%' or b.source like 'efc_%' then 'high' when b.source = 'owrs' then 'medium' when b.confidence = 'low' then 'low' else 'medium' end confidence,
        case when b.comp is null then 'no comparable bill from any source' when b.source <> 'scraped_llm' then '' when b.confidence = 'low' then 'low_confidence' when a_bill is null then 'no_anchor_available'
        when abs(b.comp - a_bill) / a_bill <= 0.25 then 'anchor_agrees (' || format('{{:.0f}}', abs(b.comp - a_bill) / a_bill * 100) || '% diff)' else 'anchor_diverges_qa_flag (' || format('{{:.0f}}', abs(b.comp - a_bill) / a_bill * 100) || '% diff)' end selection_notes, b.confidence parse_confidence, b.structure rate_structure_type, b.fixed fixed_charge_monthly, 'Works ' || b.pwsid utility_name
        from k left join b using (pwsid) left join a using (pwsid)""",
    "older_estimate": _R + f""", s as (select *, coalesce({_B}, case when bill_6ccf > 0 then bill_6ccf end) comp from r), a as (select pwsid, source a_source, comp a_bill from s where comp is not null and source in ('swrcb_ear_2022', 'swrcb_ear_2021') qualify row_number() over (partition by pwsid order by case source when 'swrcb_ear_2022' then 0 else 1 end, id) = 1),
        q as (select s.*, a_source, a_bill, abs(comp - a_bill) / a_bill df from s left join a using (pwsid)), p as (select *, case when source <> 'scraped_llm' then case source when 'swrcb_ear_2022' then 1 when 'swrcb_ear_2021' then 2 when 'owrs' then 4 when 'swrcb_ear_2020' then 5 else 99 end when confidence = 'low' then 6 when a_bill is null then 3 when df <= 0.25 then 0 else 5 end pr from q),
        b as (select * from p where comp is not null qualify row_number() over (partition by pwsid order by pr, source, id) = 1), k as (select pwsid, count(distinct source) n_sources from r group by 1)
        select k.pwsid, source selected_source, comp bill, vintage_date::varchar vintage_date, n_sources, a.a_source anchor_source, a.a_bill anchor_bill, case when comp is null then 'none' when pr = 0 or source like 'swrcb!_ear%' escape '!' then 'high' when source = 'owrs' then 'medium' when confidence = 'low' then 'low' else 'medium' end confidence,
        case when comp is null then 'no comparable bill from any source' when source <> 'scraped_llm' then '' when confidence = 'low' then 'low_confidence' when a.a_bill is null then 'no_ear_anchor' else case when df <= 0.25 then 'scraped_agrees_with_ear' else 'scraped_diverges_from_ear' end || ' (' || format('{{:.0f}}', df * 100) || '% diff)' end selection_notes from k left join b using (pwsid) left join a using (pwsid)""",
    "guessed_urls": "with g as (" + GUESSES.format(text="varchar", events="events") + """), h as (select *, coalesce(nullif(final_url, ''), guessed_url) f, replace(regexp_extract(lower(guessed_url), 'https://([^/]+)', 1), 'www.', '') ha, replace(regexp_extract(lower(coalesce(nullif(final_url, ''), guessed_url)), 'https://([^/]+)', 1), 'www.', '') hb from g where guessed_url <> ''),
        k as (select *, (confidence_tier = 'name_water') is true or contains(dom, 'water') w from h where ha = hb or len([x for x in list_intersect(string_split(ha, '.'), string_split(hb, '.')) if x not in ('com', 'org', 'net', 'gov', 'us', 'www')]) > 0)
        select pwsid, f url from k qualify row_number() over (partition by pwsid order by not w, confidence_score desc, not w and not contains(f, '.gov'), id) = 1""",
    "anchored_estimate": _R + f""", s as (select *, coalesce({_B}, case when bill_6ccf > 0 then bill_6ccf end) comp from r), c as (select pwsid, arg_min(comp, id) b from s where comp is not null and source = 'scraped_llm' group by 1), a as (select pwsid, arg_min(comp, id) b from s where comp is not null and source = 'swrcb_ear_2022' group by 1)
        select pwsid, case when c.b is not null and (a.b is null or abs(c.b - a.b) / a.b <= 0.25) then 'scraped_llm' else 'swrcb_ear_2022' end source, case when c.b is not null and (a.b is null or abs(c.b - a.b) / a.b <= 0.25) then c.b else a.b end bill from c full join a using (pwsid)""",
    "source_tiers": _R + f""", q as (select *, {SOURCES}[id % {len(SOURCES)} + 1] src from r), c as (select * from (values {", ".join(f"('{k}', {v})" for k, v in S.PUBLISHED.exact.items())}) t(name, p))
        select id, src source, coalesce(p, case when src like 'efc!_%' escape '!' or src like 'swrcb!_%' escape '!' then 3 else 5 end)::int priority, case src when 'scraped_llm' then 'premium' when 'duke_nieps_10state' then 'reference' else 'free' end tier,
        case when bill_10ccf is not null then '10ccf' when bill_9ccf is not null and bill_12ccf is not null then 'interp_10' when bill_12ccf is not null then '12ccf' end way from q left join c on name = src""",
    "coverage": "with g as (" + REGISTRY.format(text="varchar", events="events") + """), c as (select c_custkey pwsid, case when c_custkey % 3 = 0 then 'succeeded' else 'not_attempted' end old from customer)
        select pwsid, case when not exists (select 1 from g where g.pwsid = c.pwsid) then 'not_attempted'
        when exists (select 1 from g where g.pwsid = c.pwsid and g.status = 'pending') and not exists (select 1 from g where g.pwsid = c.pwsid and last_fetch_at is not null) then 'url_discovered'
        when exists (select 1 from g where g.pwsid = c.pwsid and last_parse_result = 'success') then 'succeeded'
        when exists (select 1 from g where g.pwsid = c.pwsid and last_fetch_at is not null and last_http_status is not null) then 'attempted_failed' else old end scrape_status,
        n is not null has_rate_data, sources, coalesce(n, 0) n_sources, latest from c left join (select o_custkey, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) sources, count(distinct o_orderpriority) n, max(o_orderdate) latest from orders group by 1) on o_custkey = pwsid""",
    "variance": _V + " select * from v",
    "cause_counts": _V + " select tag, count(*) n from (select unnest(string_split(divergence_causes, '; ')) tag from v where cv_pct > 25 and divergence_causes <> 'within_tolerance') group by 1",
    "combined_suspects": _S + """, o as (select pwsid, median(bill) m from s where source <> 'scraped_llm' and bill < 500 group by 1), l as (select pwsid, arg_min(bill, id) b from s where source = 'scraped_llm' and bill is not null group by 1)
        select pwsid, b scraped_bill, m other_median, round(b / m, 2) ratio from o join l using (pwsid) where b > m * 1.5 and b > 40""",
    "overlap_by_state": _S + """, a as (select pwsid, arg_min(bill, id) a from s where source like 'efc_%' and bill is not null group by 1), b as (select pwsid, arg_min(bill, id) b from s where source = 'scraped_llm' and bill is not null group by 1), p as (select *, (b - a) / a * 100 d from a join b using (pwsid))
        select pwsid[:2] state, count(*) n, median(d) median_diff, count(*) filter (abs(d) < 10) lt10, count(*) filter (abs(d) >= 10 and abs(d) < 25) b10_25, count(*) filter (abs(d) >= 25 and abs(d) < 50) b25_50, count(*) filter (abs(d) >= 50) gt50, count(*) filter (abs(d) >= 50 and d > 0) higher, avg(a) avg_a, avg(b) avg_b from p group by 1""",
    "year_gaps": _S + """, x as (select * from s where bill is not null and vintage is not null), a as (select pwsid, bill, vintage from x where source = 'efc_nc_2025' qualify row_number() over (partition by pwsid order by id) = 1), b as (select pwsid, bill, vintage from x where source = 'scraped_llm' qualify row_number() over (partition by pwsid order by id) = 1),
        p as (select (year(b.vintage) - year(a.vintage))::int gap, abs((b.bill - a.bill) / a.bill * 100) d from a join b using (pwsid)) select gap, count(*) n, quantile_cont(d, 0.25) p25, quantile_cont(d, 0.5) p50, quantile_cont(d, 0.9) p90, stddev_samp(d) sd from p group by 1 having count(*) >= 2""",
    "runs_compared": """with a as (select o_orderkey id, case when o_orderkey % 9 > 0 then o_orderkey % 700 end o from orders), n as (select id, coalesce(o, 0) o, coalesce(case id % 4 when 0 then o * 3 when 1 then o + 400 when 2 then o - 5 end, 0) n from a where id % 7 > 0)
        select id, o "old", n "new", case when o < 200 and n >= 500 then 'recovered' when n > 2 * o and n < 500 then 'improved' when n < o and o > 0 then 'degraded' else 'unchanged' end outcome from n""",
    "source_parity": _R + """, z as (select source, count(*) filter (source <> 'owrs') rows_a, count(distinct pwsid) filter (source <> 'owrs') keys_a, count(*) filter (id % 3 > 0 and source <> 'other') rows_b, count(distinct pwsid) filter (id % 3 > 0 and source <> 'other') keys_b from r group by 1)
        select *, rows_a - rows_b gap from z""",
    "disagreements": _R + """, p as (select case when id % 11 = 0 then null when id % 13 = 0 then 0 when id % 17 = 0 then 600 when id % 5 = 2 then bill_10ccf * 6 else bill_20ccf end a, bill_10ccf b, case when id % 3 > 0 then bill_10ccf / 2 end b5, bill_20ccf b20, structure from r),
        v as (select *, (a - b) / b * 100 d from p where a > 0 and b > 0) select count(*) filter (abs(d) >= 400) factor, count(*) filter (d >= 400) higher, count(*) filter (d <= -400) lower, (select count(*) from p where (a is null or a = 0) and b > 5) missing, count(*) filter (a > 500 and b < 100) high_low,
        count(*) filter (structure in ('flat', 'uniform') and b20 / greatest(b5, 1) > 2.5 and b5 is not null) steep, count(*) filter (a > 200) "large", count(*) filter (a > 200 and abs(d) < 25) large_agreed, count(*) filter (a > 200 and abs(d) >= 50) large_apart from v""",
    "record_checks": _S + """ select id, concat_ws('; ', case when ear then 'ear_tier_limit_inflated (' || case when top_limit / 3 > 60000 then 'tier_1_limit_ccf=' || format('{:.0f}', top_limit / 3) else 'tier_2_limit_ccf=' || format('{:.0f}', top_limit) end || ')' end, case when lo then 'bill_suspiciously_low ($' || format('{:.2f}', bill) || ')' end, case when hi then 'bill_suspiciously_high ($' || format('{:.0f}', bill) || ')' end, case when fh then 'fixed_charge_high ($' || format('{:.0f}', fixed) || ')' end, case when fn then 'fixed_charge_negative' end, case when old then 'stale_vintage (' || year(vintage) || ')' end) flags,
        concat_ws('; ', case when id % 4 = 0 or fixed = 0 then 'no_tier_1_rate' end, case when id % 4 > 0 and fixed / 4 < 0.1 then 'tier_1_rate_too_low:' || (fixed / 4)::varchar end, case when id % 4 > 0 and fixed / 4 > 50 then 'tier_1_rate_too_high:' || (fixed / 4)::varchar end, case when id % 4 > 1 and fixed / 2 < 0.1 then 'tier_2_rate_too_low:' || (fixed / 2)::varchar end, case when id % 4 > 1 and fixed / 2 > 50 then 'tier_2_rate_too_high:' || (fixed / 2)::varchar end,
        case when fixed * 3 > 500 then 'fixed_charge_high:' || (fixed * 3)::varchar end, case when confidence is null or confidence = 'failed' then 'confidence_failed' end) issues,
        coalesce(abs(bill_10ccf - bill_20ccf) < 0.01 and structure <> 'flat', false) "identical", case when bill_10ccf between 10 and 200 and id % 4 >= 2 then 'high' when bill_10ccf between 5 and 500 then 'medium' else 'low' end grade,
        coalesce(year(vintage) <= 1997, false) stale, coalesce(bill_12ccf - bill_9ccf > 20, false) high_variance from f""",
    "bias_by_group": _S + """, a as (select pwsid, arg_min(bill, id) a from s where source like 'efc!_%' escape '!' and bill is not null group by 1), b as (select pwsid, arg_min(bill, id) b from s where source = 'scraped_llm' and bill is not null group by 1),
        p as (select substring(pwsid, 8, 2) grp, (b - a) / a * 100 d from a join b using (pwsid)), g as (select grp, count(*) n, median(d) median_diff, 100.0 * count(*) filter (d > 0) / count(*) up from p group by 1 having count(*) >= 5)
        select grp, n, median_diff, case when median_diff > 0 then 'b' else 'a' end higher, abs(median_diff) > 20 and (up > 70 or up < 30) systematic from g""",
    "issue_audit": _R + """, m as (select state_code, avg(bill_10ccf) m, stddev_samp(bill_10ccf) s from r group by 1) select state_code, count(*) filter (bill_10ccf is null) missing, count(*) filter (bill_10ccf = bill_20ccf and structure in ('uniform', 'increasing_block')) "identical", count(*) filter (abs(bill_10ccf - m) > 1.5 * s) outliers, count(*) filter (year(vintage_date) < 1997) stale from r join m using (state_code) group by 1""",
    "complete_rows": _R + """, b as (select pwsid, id from r qualify row_number() over (partition by pwsid order by (bill_10ccf is not null)::int + (bill_9ccf is not null)::int + (bill_12ccf is not null)::int desc, vintage_date desc nulls last, id) = 1),
        k as (select pwsid, case when bool_or(structure = 'increasing_block') then 'increasing_block' when bool_or(structure = 'uniform') then 'uniform' when bool_or(structure = 'flat') then 'flat' end category, case when bool_or(id % 6 = 5) then 0.625::double else min(id % 6) / 8 end meter_size from r group by 1)
        select pwsid, id, category, meter_size from b join k using (pwsid)""",
}
