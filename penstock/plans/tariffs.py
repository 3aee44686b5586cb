"""Tariff functions as queries, each with SQL that works out the result in another way."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tariff as T
from ..sources.readers import table

#: Four-tier schedules made from parts: limits in CCF, rates per CCF, a fixed charge, a meter and a billing period.
WIDE = """select p_partkey k, p_partkey % 5 n,
  case when p_partkey % 5 > 1 then 5 + p_partkey % 3 end::double l1, case when p_partkey % 5 > 2 then 12 + p_partkey % 4 end::double l2,
  case when p_partkey % 5 > 3 then 20 + p_partkey % 6 end::double l3,
  case when p_partkey % 5 >= 1 then 1 + p_partkey * 3 % 7 * 0.5 end::double r1, case when p_partkey % 5 >= 2 then 1.5 + p_partkey * 5 % 7 * 0.5 end::double r2,
  case when p_partkey % 5 >= 3 then 2 + p_partkey * 2 % 7 * 0.5 end::double r3, case when p_partkey % 5 >= 4 then 2.5 + p_partkey * 4 % 7 * 0.5 end::double r4,
  case when p_partkey % 11 = 0 then null when p_partkey % 7 = 0 then 0 else p_partkey % 40 + 0.25 end::double fixed,
  case when p_partkey % 3 = 0 then '0.75' when p_partkey % 3 = 1 then '0.625' end meter,
  case when p_partkey % 4 = 0 then 'monthly' when p_partkey % 4 = 1 then 'Bimonthly' when p_partkey % 4 = 2 then ' quarterly ' else 'semi-annual' end period from {part}"""


def _sql(spark, d, query, *tables):
    # a row's folds cost much more than its bytes: rows are dealt over all cores, however small the file
    n = 3 * spark.sparkContext.defaultParallelism
    return spark.sql(query, **{t: table(spark, d, t).repartition(n) for t in tables})


def _wide(spark, d):
    w = _sql(spark, d, WIDE, "part")
    tiers = T.tiers_from_wide([F.col("l1"), F.col("l2"), F.col("l3"), F.lit(None).cast("double")], [F.col(f"r{k}") for k in (1, 2, 3, 4)])
    return w.withColumn("tiers", tiers).withColumn("charges", T.fixed_charges(F.col("fixed"), F.col("meter")))


def wide_tiers(spark, d):
    """NEST-3, NEST-4, NEST-5, MATH-13: wide columns to arrays and back to single values."""
    t = lambda k, f: F.get("tiers", F.lit(k))[f]
    return _wide(spark, d).select("k", F.coalesce(F.size("tiers"), F.lit(-1)).alias("n_tiers"), t(0, "min_gal").alias("min1"), t(1, "min_gal").alias("min2"), t(0, "max_gal").alias("max1"), t(2, "max_gal").alias("max3"), t(1, "rate_per_1000_gal").alias("rate2"), F.get("charges", F.lit(0))["meter_size"].alias("meter_size"), T.fixed_monthly(F.col("charges")).alias("fixed_monthly"))


def schedule_bills(spark, d):
    """MATH-2, MATH-3: bills at three volumes by the rules of the sources."""
    at = lambda ccf, mode: T.bill(T.fixed_monthly(F.col("charges")), F.col("tiers"), F.lit(ccf * T.CCF_GALLONS), mode=mode)
    return _wide(spark, d).select("k", at(5, "schedule").alias("bill_5ccf"), at(20, "schedule").alias("bill_20ccf"), at(40, "extend").alias("extend_40ccf"), at(10, "fixed_only").alias("llm_10ccf"), at(10, "strict").alias("strict_10ccf"))


def limit_bills(spark, d):
    """MATH-1: bills from limit and rate pairs in CCF."""
    pairs = F.array(*[F.struct(F.col(f"l{k}").alias("limit") if k < 4 else F.lit(None).cast("double").alias("limit"), F.col(f"r{k}").alias("rate")) for k in (1, 2, 3, 4)])
    return _sql(spark, d, WIDE, "part").select("k", *[T.bill_by_limits(F.col("fixed"), pairs, F.lit(float(c))).alias(f"bill_{c}ccf") for c in (3, 10, 30)])


def tier_shapes(spark, d):
    """MATH-4, MATH-5, NEST-2, NEST-8: signal, structure, audit and a predicate on elements."""
    rates = F.transform("tiers", lambda t: t["rate_per_1000_gal"])
    audit = T.audit(F.col("tiers"))
    return _wide(spark, d).select("k", T.conservation_signal(F.col("tiers")).alias("signal"), T.structure_type(rates).alias("structure"), T.structure_type(rates, decreasing_first=True).alias("structure_ky"), T.has_tier_above(F.col("tiers"), 16000.0).alias("tall"), audit["n"].alias("n"), audit["gap"].alias("gap"), audit["repeated"].alias("repeated"))


def period_bills(spark, d):
    """MATH-14, MATH-12: bills per period as bills per month; a missing bill is filled in from tiers, a present one stays."""
    have = F.when(F.col("k") % 3 == 0, F.col("fixed"))
    monthly = T.bill(T.per_month(F.col("fixed"), F.col("period")), T.tiers_per_month(F.col("tiers"), F.col("period")), F.lit(10 * 748.0))
    return _wide(spark, d).select("k", T.divisor_of(F.col("period")).alias("months"), F.coalesce(have, monthly).alias("bill"))


#: Curves of seven points with a step of 500 or 1000 gallons, made from suppliers.
CURVE = """select s_suppkey k, case when s_suppkey % 2 = 0 then 500 else 1000 end step, s_suppkey % 3 + 1 divisor, 4 + s_suppkey % 9 base, s_suppkey % 5 a, s_suppkey % 7 b from {supplier}"""


def _curve(spark, d):
    point = lambda i: (F.col("step") * i, F.col("base") + F.col("a") * F.least(F.lit(i), F.lit(3)) + F.col("b") * F.greatest(F.lit(i - 3), F.lit(0)))
    entries = [x.cast("string") for i in range(16) for x in point(i)]
    return _sql(spark, d, CURVE, "supplier").withColumn("curve", T.curve_of(F.create_map(*entries, F.lit("note"), F.lit("x"))))


def curve_bills(spark, d):
    """SRC-13, MATH-7, MATH-8: bills read from a curve that came as a map of texts."""
    at = lambda ccf, **how: T.bill_from_curve(F.col("curve"), F.lit(float(ccf)), F.col("divisor"), per_ccf=750.0, **how)
    return _curve(spark, d).select("k", at(0).alias("bill_0"), at(1).alias("bill_1"), at(2.5).alias("bill_2h"), at(24).alias("bill_24"), at(24, extrapolate=True).alias("more_24"))


def curve_tiers(spark, d):
    """WIN-1, WIN-2, MATH-6, NEST-11: tiers found in a curve, as at most four in CCF."""
    tiers = T.tiers_of_curve(F.col("curve"))
    four = T.four_tiers(F.col("t"), F.col("divisor"), per_ccf=750.0)
    return _curve(spark, d).withColumn("t", tiers).withColumn("four", four).select("k", F.size("t").alias("islands"), F.get("t", F.lit(0))["is_allowance"].alias("allowance"), F.get("t", F.lit(0))["end_gal"].alias("end_gal"), F.size("four.tiers").alias("n"), F.get("four.tiers", F.lit(0))["limit_ccf"].alias("limit1"), F.get("four.tiers", F.lit(0))["rate"].alias("rate1"), F.col("four.overflow_note").alias("note"))


def two_point_bills(spark, d):
    """MATH-9, MATH-10, MATH-11: bills from one or two known points."""
    c = _sql(spark, d, "select c_custkey k, case when c_custkey % 6 > 0 then 20 + c_custkey * 7 % 30 end::double lo, case when c_custkey % 10 > 0 then 25 + c_custkey * 3 % 30 end::double hi, case when c_custkey % 4 > 0 then 12 end::double least from {customer}", "customer")
    two = T.two_point_model(F.col("least"), F.col("lo"), F.col("hi"), per_ccf=750.0)
    ten = T.bills_from_5k_10k(F.col("lo"), F.col("hi"), per_ccf=750.0)
    c = c.withColumn("m", two).withColumn("t", ten)
    return c.select("k", "m.structure_type", "m.rate_per_kgal", "m.fixed", F.col("m.bill_10ccf").alias("b10"), F.col("t.bill_5ccf").alias("t5"), F.col("t.bill_20ccf").alias("t20"), "t.method", T.proportional_20ccf(F.col("hi"), F.when(F.col("k") % 2 == 0, F.col("lo"))).alias("p20"), T.bill_outliers(F.col("hi") * 8 - 200).alias("review"))


def line_tiers(spark, d):
    """SRC-12, NEST-10, QC-7: a text with a value a line to tiers."""
    c = _sql(spark, d, r"select c_custkey k, case when c_custkey % 5 = 0 then 'indoor\n7\n9' when c_custkey % 7 = 0 then null else '0\n 7 \n\n' || (9 + c_custkey % 4) end starts, case when c_custkey % 6 = 0 then '1.5\nx' when c_custkey % 4 = 0 then '1.5\n2.25' else '1.5\n2.25\n' || (3 + c_custkey % 3) end prices, c_custkey % 2 = 0 kgal from {customer}", "customer")
    c = c.withColumn("t", T.tiers_from_lines(F.col("starts"), F.col("prices"), F.col("kgal"), per_ccf=750.0))
    return c.select("k", F.size("t").alias("n"), F.get("t", F.lit(0))["limit_ccf"].alias("limit1"), F.get("t", F.lit(1))["limit_ccf"].alias("limit2"), F.get("t", F.lit(1))["rate_ccf"].alias("rate2"), F.get("t", F.lit(2))["rate_ccf"].alias("rate3"))


def parsed_tiers(spark, d):
    """NEST-9, WIN-3, NEST-7, NEST-1: tiers of a parsed document, with the gaps of one gallon closed."""
    text = F.format_string('[{"from_gal":0,"to_gal":%d},{"from_gal":0,"to_gal":%d,"rate":0.002},{"from_gal":%d,"to_gal":null,"rate":0.00%d}]', F.lit(2000), F.col("k") * 100, F.col("k") * 100 + F.col("k") % 3, 1 + F.col("k") % 8)
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    s = s.withColumn("t", T.tiers_from_parsed(F.from_json(text, "array<struct<from_gal:double,to_gal:double,rate:double>>"), F.lit(False)))
    plain = lambda t: F.transform(t, lambda x: F.struct(x["min_gal"], x["max_gal"], x["rate_per_1000_gal"]))
    twice = T.numbered(F.concat(plain(F.col("t")), plain(F.col("t"))))
    return s.withColumn("u", twice).select("k", F.size("t").alias("n"), F.get("t", F.lit(1))["min_gal"].alias("min2"), F.get("t", F.lit(1))["rate_per_1000_gal"].alias("rate2"), F.size("u").alias("n_once"), F.get("u", F.lit(1))["tier"].alias("number2"), F.get("u", F.lit(1))["min_gal"].alias("contiguous2"))


def cubic_tiers(spark, d):
    """MATH-13 for cubic feet: bounds and rates in gallons, with an adjustment."""
    c = _sql(spark, d, "select c_custkey k, c_custkey % 3 * 100.0D lo, case when c_custkey % 4 = 0 then 1e9 when c_custkey % 4 = 1 then null else 1000.0 + c_custkey end hi, case when c_custkey % 9 > 0 then 100.0D end base, c_custkey % 5 + 0.5D cost, case when c_custkey % 3 = 0 then 0.5D end adj, c_custkey % 2 = 0 cubic from {customer}", "customer")
    c = c.withColumn("t", T.cubic_tier(F.col("lo"), F.col("hi"), F.col("base"), F.col("cost"), F.col("adj"), cubic=F.col("cubic"), per_foot=7.5))
    return c.select("k", "t.min_gal", "t.max_gal", "t.rate_per_1000_gal")


def repairs(spark, d):
    """MATH-15, MATH-16, MATH-17, NEST-6, NEST-12, SINK-16: repairs of single schedules, with their notes."""
    w = _wide(spark, d).withColumn("b12", F.col("k").cast("double")).withColumn("big", F.transform("tiers", lambda t: T.tier(t["tier"], t["min_gal"], t["max_gal"] * (F.col("k") % 9), t["rate_per_1000_gal"])))
    fixed = T.inflated_repair(F.col("big"), {"bill_12ccf": F.col("b12"), "bill_24ccf": F.col("b12") / 3})
    note = F.when(fixed["confidence"].isNotNull(), F.concat(F.lit("TRIAGE "), F.col("k").cast("string")))
    old = F.when(F.col("k") % 2 == 0, F.concat(F.lit("n"), F.col("k").cast("string")))
    more = T.with_line_item(T.without_key(F.col("charges"), ["name", "amount", "meter_size"]), "Surcharge", F.lit(5.0), old, "n2")
    return w.select("k", F.size(fixed["volumetric_tiers"]).alias("n_tiers"), fixed["bill_12ccf"].alias("bill_12ccf"), fixed["bill_24ccf"].alias("bill_24ccf"), fixed["confidence"].alias("confidence"), F.nullif(F.concat_ws("; ", old, note), F.lit("")).alias("notes"), T.fixed_monthly(more).alias("charged"), T.decimal_repair(F.col("b12") * 10).alias("repaired"), F.round(T.percent_change(F.col("fixed"), F.col("b12")), 1).alias("change"))


def wide_curves(spark, d):
    """SRC-14: bill curves of wide columns, up to the first that is empty."""
    c = table(spark, d, "customer").select("c_custkey", *[F.when(F.col("c_custkey") % 11 != k, F.concat(F.col("c_custkey") % 9 + k * 3, F.lit(".5"))).otherwise("NA").alias(f"total_bill_{k * 500}") for k in range(8)])
    curve = T.curve_of_columns({k * 500: F.col(f"total_bill_{k * 500}") for k in range(8)})
    return c.select("c_custkey", F.size(curve).alias("n"), F.aggregate(curve, F.lit(0.0), lambda s, x: s + x["bill"]).alias("total"), F.try_element_at(curve, F.lit(-1))["gal"].alias("last"))


QUERIES = {f.__name__: f for f in (wide_tiers, schedule_bills, limit_bills, tier_shapes, period_bills, curve_bills, curve_tiers, two_point_bills, line_tiers, parsed_tiers, cubic_tiers, repairs, wide_curves)}

_W = f"with w as ({WIDE.format(part='part')}), "
#: Gallon bounds and rates per 1000 gallons of the schedules, written out.
_G = _W + """g as (select *, round(l1 * 748, 0) g1, round(l2 * 748, 0) g2, round(l3 * 748, 0) g3,
  round(r1 * (1000.0::double / 748), 4) q1, round(r2 * (1000.0::double / 748), 4) q2, round(r3 * (1000.0::double / 748), 4) q3, round(r4 * (1000.0::double / 748), 4) q4,
  coalesce(round(fixed, 2), 0) f from w)"""


def _charge(v: str, extend: bool = False) -> str:
    """Charge of the schedules at a volume: the part of it in each tier."""
    top = "1e18" if extend else "0"
    part = lambda q, lo, hi: f"greatest(least({v}::double, coalesce({hi}, 1e18)) - {lo}, 0) / 1000 * {q}"
    return f"case n when 0 then 0::double when 1 then {part('q1', '0', 'g1')} when 2 then {part('q1', '0', 'g1')} + {part('q2', 'g1', 'null')} when 3 then {part('q1', '0', 'g1')} + {part('q2', 'g1', 'g2')} + {part('q3', 'g2', 'null')} else {part('q1', '0', 'g1')} + {part('q2', 'g1', 'g2')} + {part('q3', 'g2', 'g3')} + {part('q4', 'g3', 'null')} end"


_C = f"with c as ({CURVE.format(supplier='supplier')}), p as (select *, i * step gal, (base + a * least(i, 3) + b * greatest(i - 3, 0))::double bill from c, range(16) r(i))"


def _at(ccf: float, extrapolate: bool = False) -> str:
    """A scalar of the curve's points: the bill at a volume."""
    v = f"({ccf} * 750.0 * c.divisor)::double"
    inside = "ba + ({v} - ga) / (gb - ga) * (bb - ba)".format(v=v)
    if not extrapolate:
        inside = f"case when {v} - ga <= (gb - ga) * 0.1::double then ba when gb - {v} <= (gb - ga) * 0.1::double then bb else {inside} end"
    beyond = f"(select arg_max(bill, gal) from p where p.k = c.k) + b::double / step * ({v} - 15 * step)" if extrapolate else "null"
    return f"""(select round((case when gb is null then {beyond} when ga is null then bb else {inside} end) / c.divisor, 2) from (select max(gal) filter (gal < {v}) ga, arg_max(bill, gal) filter (gal < {v}) ba, min(gal) filter (gal >= {v}) gb, arg_min(bill, gal) filter (gal >= {v}) bb from p where p.k = c.k))"""


ORACLE = {
    "wide_tiers": _G + """select k, case n when 0 then -1 else n end::int n_tiers, case when n > 0 then 0::double end min1, case when n > 1 then g1 end min2, g1 max1, g3 max3, case when n > 1 then q2 end rate2,
        case when fixed <> 0 then meter end meter_size, f fixed_monthly from g""",
    "schedule_bills": _G + f"""select k, round(nullif(f + {_charge("3740")}, 0), 2) bill_5ccf, round(nullif(f + {_charge("14960")}, 0), 2) bill_20ccf, round(f + {_charge("29920")}, 2) extend_40ccf, round(f + {_charge("7480")}, 2) llm_10ccf, case when n > 0 then round(f + {_charge("7480")}, 2) end strict_10ccf from g""",
    "limit_bills": _W + "x as (select * from w, (values (3), (10), (30)) v(c)), y as (select k, c, round(coalesce(fixed, 0) + case n when 1 then c * r1 when 2 then least(c, l1) * r1 + greatest(c - l1, 0) * r2 when 3 then least(c, l1) * r1 + greatest(least(c, l2) - l1, 0) * r2 + greatest(c - l2, 0) * r3 when 4 then least(c, l1) * r1 + greatest(least(c, l2) - l1, 0) * r2 + greatest(least(c, l3) - l2, 0) * r3 + greatest(c - l3, 0) * r4 end, 2) b from x) select k, max(b) filter (c = 3) bill_3ccf, max(b) filter (c = 10) bill_10ccf, max(b) filter (c = 30) bill_30ccf from y group by k",
    "tier_shapes": _G + """, s as (select *, [x for x in [q1, q2, q3, q4] if x is not null] rates from g)
        select k, case when n > 1 then round(list_max(rates) / list_min(rates), 2) end signal,
        case when n = 0 then 'flat' when n = 1 then 'uniform' when rates = list_sort(rates) then 'increasing_block' when rates = list_reverse_sort(rates) then 'decreasing_block' else 'increasing_block' end structure,
        case when n = 0 then 'flat' when n = 1 then 'uniform' when rates = list_reverse_sort(rates) then 'decreasing_block' else 'increasing_block' end structure_ky,
        coalesce(g3, g2, g1, 0) > 16000 tall, n::int n, false gap, false repeated from s""",
    "period_bills": _G + """, m as (select *, case k % 4 when 0 then 1 when 1 then 2 when 2 then 3 else 6 end as "months" from g),
        z as (select k, months, case when k % 3 = 0 then fixed end have, coalesce(fixed, 0) / months f, n, g1 / months g1, g2 / months g2, g3 / months g3, q1, q2, q3, q4 from m)
        select k, months, coalesce(have, round(nullif(f + """ + _charge("7480") + ", 0), 2)) bill from z",
    "curve_bills": _C + f" select k, {_at(0)} bill_0, {_at(1)} bill_1, {_at(2.5)} bill_2h, {_at(24)} bill_24, {_at(24, True)} more_24 from c",
    "curve_tiers": _C + """, z as (select k, divisor, a * 1000.0::double / step ra, b * 1000.0::double / step rb, 3 * step cut from c)
        select k, case when a = b then 1 else 2 end::int islands, a = 0 allowance, case when a <> b then cut end::bigint end_gal,
        (case when a = b then (a > 0)::int else (a > 0)::int + (b > 0)::int end)::int n,
        case when a > 0 and a <> b then round(cut / 750.0::double / divisor, 2) end limit1,
        case when a > 0 then round(ra * 750 / 1000, 4) when b > 0 then round(rb * 750 / 1000, 4) end rate1, null::varchar note from z join c using (k, divisor)""",
    "two_point_bills": """with c as (select c_custkey k, case when c_custkey % 6 > 0 then 20 + c_custkey * 7 % 30 end::double lo, case when c_custkey % 10 > 0 then 25 + c_custkey * 3 % 30 end::double hi, case when c_custkey % 4 > 0 then 12 end::double least from customer),
        s as (select *, (hi - lo) / 600 sl from c), f as (select *, hi - sl * 4000 i from s),
        g as (select *, case when hi is null then null when lo is null then 'uniform' when sl < 0 then 'decreasing_block' when sl = 0 then 'flat' else 'uniform' end structure_type from f)
        select k, structure_type, case when lo is null or sl = 0 then null when sl < 0 then round(hi / 4000 * 1000, 2) else round(sl * 1000, 2) end rate_per_kgal,
        case when hi is null then null when lo is null then least when sl < 0 then coalesce(least, 0) when sl = 0 then hi when i >= 0 then round(i, 2) else least end fixed,
        case when hi is null then null when lo is null or sl < 0 then round(hi * (7500.0::double / 4000), 2) when sl = 0 then hi else round(coalesce(case when i >= 0 then round(i, 2) else least end, 0) + sl * 10 * 750, 2) end b10,
        round(case when hi is null then lo * (3750.0::double / 5000) else 2 * lo - hi + (hi - lo) / 5000 * 5 * 750 end, 2) t5, round(2 * lo - hi + (hi - lo) / 5000 * 20 * 750, 2) t20,
        case when lo is null then null when hi is null then 'extrapolated_1pt' else 'interpolated_2pt_linear' end "method", coalesce(case when k % 2 = 0 then lo end, round(2 * hi, 2)) p20,
        case when hi * 8 - 200 > 200 then format('bill_10ccf=${:.2f} > $200', hi * 8 - 200) when hi * 8 - 200 < 5 then format('bill_10ccf=${:.2f} < $5', hi * 8 - 200) end review from g""",
    "line_tiers": """with c as (select c_custkey k, c_custkey % 5 = 0 bad, c_custkey % 7 = 0 and c_custkey % 5 > 0 gone, 9 + c_custkey % 4 s3, c_custkey % 6 = 0 text, case when c_custkey % 4 = 0 then 2 else 3 end np, 3 + c_custkey % 3 p3, c_custkey % 2 = 0 kgal from customer),
        n as (select *, case when gone or text then 0 else np end n, case when kgal then 0.75::double else 1 end u from c)
        select k, n::int n, case when n > 1 and not bad then round(7 / u, 2) end limit1, case when n > 2 and not bad then round(s3 / u, 2) end limit2, case when n > 1 then round(2.25 * u, 4) end rate2, case when n > 2 then round(p3 * u, 4) end rate3 from n""",
    "parsed_tiers": """select s_suppkey k, 2 n, (s_suppkey * 100 + case when s_suppkey % 3 = 2 then 2 else 0 end)::double min2, round((1 + s_suppkey % 8)::double, 4) rate2, 2 n_once, 2 number2, (s_suppkey * 100)::double contiguous2 from supplier""",
    "cubic_tiers": """with c as (select c_custkey k, c_custkey % 3 * 100.0::double lo, case when c_custkey % 4 > 1 then 1000.0 + c_custkey end::double hi, c_custkey % 9 > 0 ok, c_custkey % 5 + 0.5::double cost, case when c_custkey % 3 = 0 then 0.5 else 1 end::double adj, case when c_custkey % 2 = 0 then 7.5 else 1 end::double u from customer)
        select k, case when ok then round(lo * u, 0) end min_gal, case when ok then round(hi * u, 0) end max_gal, case when ok then round(cost * adj / (100 * u / 1000), 4) end rate_per_1000_gal from c""",
    "repairs": _G + """, b as (select *, coalesce(greatest(g1, g2, g3) * (k % 9) > 74800, false) bad, coalesce(k < 2 or k > 500 or k / 3 > 500, false) sus from g),
        o as (select *, case when k % 2 = 0 then 'n' || k end o from b)
        select k, case when not bad and n > 0 then n end::int n_tiers, case when not (bad and sus) then k::double end bill_12ccf, case when not (bad and sus) then k::double / 3 end bill_24ccf, case when bad and sus then 'low' when bad then 'medium' end confidence,
        case when o is not null and bad then o || '; TRIAGE ' || k when bad then 'TRIAGE ' || k else o end notes, f + case when starts_with(coalesce(o, ''), 'n2') then 0 else 5 end charged,
        case when k * 10 <= 500 then k * 10 when k * 10 / 100.0 > 10 and k * 10 / 100.0 < 500 then k * 10 / 100.0 end::double repaired, round(case when fixed > 0 then (k - fixed) / fixed * 100 end, 1) change from o""",
}


def exact_sql(sql: str) -> str:
    """SQL with round(x, digits) as printing the exact binary value rounds."""
    out, at = "", 0
    while (k := sql.find("round(", at)) >= 0:
        depth, j, comma = 1, k + 6, -1
        while depth:
            c = sql[j]
            depth += (c in "([{") - (c in ")]}")
            comma = j if c == "," and depth == 1 else comma
            j += 1
        if comma < 0 or not sql[comma + 1 : j - 1].strip().isdigit():
            out, at = out + sql[at : k + 6], k + 6
            continue
        out += sql[at:k] + f"format('{{:.{sql[comma + 1 : j - 1].strip()}f}}', ({exact_sql(sql[k + 6 : comma])})::double)::double"
        at = j
    return out + sql[at:]


ORACLE["wide_curves"] = "with n as (select c_custkey, (case when c_custkey % 11 < 8 then c_custkey % 11 else 8 end)::int n from customer) select c_custkey, n, coalesce(list_sum([c_custkey % 9 + k * 3 + 0.5 for k in range(n)]), 0)::double total, case when n > 0 then (n - 1) * 500 end::bigint \"last\" from n"
ORACLE = {k: exact_sql(v) for k, v in ORACLE.items()}
