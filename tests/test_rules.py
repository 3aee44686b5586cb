"""Rules of texts, links, names, dates and numbers on literal cases."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from penstock.functions import names, numbers, scores, text
from penstock.operators import quality, queues, reconcile, selection


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def each(spark, kind, values, fn):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["x"] for r in df.select("k", fn(F.col("v")).alias("x")).orderBy("k").collect()]


def test_rounding_like_binary_numbers(spark):
    rng = random.Random(11)
    values = [2.675, 0.125, 0.375, 1.005, -2.675, 0.0, 5e-324, 1e12 + 0.125, -0.125, 1e300, 2.5, 3.5]
    values += [k / 1000 for k in range(5, 200_000, 10)] + [rng.randrange(1, 10**7) / 8 for _ in range(100_000)] + [rng.uniform(-(10.0 ** rng.randrange(-3, 12)), 10.0 ** rng.randrange(-3, 12)) for _ in range(200_000)] + [math.nextafter(k + 0.005, 9e9 * (k % 2)) for k in range(100_000)]
    df = spark.createDataFrame(list(enumerate(values)), "k long, v double").repartition(8)
    got = df.select("k", numbers.exact_round(F.col("v")).alias("two"), numbers.exact_round(F.col("v"), 0).alias("none"), numbers.exact_round(F.col("v"), 4).alias("four")).toPandas().sort_values("k")
    for name, digits in (("two", 2), ("none", 0), ("four", 4)):
        assert (got[name].to_numpy() == np.array([round(v, digits) for v in values])).all()
    assert one(spark, numbers.exact_round(F.lit(None)), F.isnan(numbers.exact_round(F.lit(float("nan"))))) == (None, True)


def test_dates(spark):
    cases = {"6/1/95": "1995-06-01", "6/1/68": "2068-06-01", "2023-7-4": "2023-07-04", "07/01/2023": "2023-07-01", "July 1, 2023": "2023-07-01", "Jul 1, 2023": "2023-07-01", "1998": "1998-01-01", "effective 2021": "2021-01-01", "2/30/2023": "2023-01-01", "soon": None, "": None, "2023-02-29": "2023-01-01", "May 5, 2020": "2020-05-05", "FY2019-2020": "2019-01-01", "13/1/99": None}
    assert each(spark, "string", list(cases), text.dated) == [d and dt.date.fromisoformat(d) for d in cases.values()]


def test_reasons_to_skip(spark):
    pad = "All about our water utility and its customers. " * 20
    cases = {
        None: "empty_content", " \n\t ": "empty_content", "short": "too_short (5 chars)", "x" * 100 + " Coming Soon": "parked_domain (coming soon)", "lorem " * 30: "short_no_water_keywords (179 chars)", "Fees of the water works by the tariff, tier 1 and tier 2 per 1,000 gallons. " * 5: None,
        "lorem ipsum dolor " * 50: "no_financial_or_rate_content", "lorem ipsum dolor " * 50 + "$5": None, pad: "no_financial_or_rate_content", pad + " index of / ": "parked_domain (index of /)",
    }
    assert each(spark, "string", list(cases), text.skip_reason) == list(cases.values())


def test_scripted_and_empty_pages(spark):
    got = one(spark, *[text.looks_scripted(F.lit(h), F.lit(t)) for h, t in (("<script>" * 6, "x"), ("<script>" * 5, "x"), ("<script>" * 60, "x" * 200), ('<div id="react-root">', "x"), ("__NEXT_DATA__", "y" * 300))])
    assert got == (True, False, False, True, False)
    cases = [("Tier 1 rates", 900), ("Tier 1 $1.25 $2.50 $3.00", 900), ("nothing", 499), ("nothing", 500), ("Monthly Base $5.00", 100), (None, 10), ("meter  size\nper 1000", 800)]
    assert one(spark, *[text.empty_table(F.lit(t), F.lit(n)) for t, n in cases]) == ("js_table_empty", None, "thin_page", None, "js_table_empty", "thin_page", "js_table_empty")


def test_categories(spark):
    table = {"flat rate": "flat", "tiered rates (inclining block)": "increasing_block"}
    cases = {" Flat ": "flat", "FLAT RATE": "flat", "tiered rates (inclining block) since 2020": "increasing_block", "Not Found": None, "we are unable to determine it": None, "sewer": None, "sewer and water flat": None, "something else": None, "": None, None: None, "not found here": None, "budget_based": "budget_based"}
    assert each(spark, "string", list(cases), lambda c: text.normal_category(c, table)) == list(cases.values())


def test_identifiers_and_titles(spark):
    cases = {"03-63-020": "NC0363020", "12345": "NC12345", "nc-03 63": "NC0363", "abc-1x": "ABC-1X", "NA": None, "": None, "1234567": "NC1234567", None: None, "12-345-6789": "NC123456789"}
    assert each(spark, "string", list(cases), lambda c: text.identifier(c, F.lit("nc"))) == list(cases.values())
    titles = {"CORNWALL-ON-HUDSON": "Cornwall-On-Hudson", "NEW WINDSOR": "New Windsor", "TOWN AND COUNTRY": "Town And Country", "SAULT LE POINT": "Sault le Point", "ISLE OF WIGHT": "Isle of Wight", "of the lake": "Of the Lake", "": ""}
    assert each(spark, "string", list(titles), text.place_title) == list(titles.values())


@pytest.mark.parametrize(("name", "county", "long"), [("STAFFORD CO UTIL", "Stafford", "STAFFORD County Utilities"), ("PWCSA - EAST", "Prince William", "Prince William County Service Authority"), ("ACSA URBAN AREA", "Albemarle", "Albemarle County Service Authority"), ("NAVAL STATION NORFOLK", None, "NAVAL STATION NORFOLK"), ("HRWD", "Essex", "Essex Water District"), ("BVU", "Bristol", "Bristol County Water"), ("IRVINE RANCH WATER DISTRICT", "Orange", "IRVINE RANCH WATER DISTRICT")])
def test_names_written_out(spark, name, county, long):
    assert one(spark, text.expand(F.lit(name), F.lit(county).cast("string")))[0] == long


def test_search_texts(spark):
    of = lambda *a: one(spark, text.queries_of(*[F.lit(x).cast("string") for x in a]))[0]
    assert of("CAL AM - SUBURBAN ROSEMONT", "CA", "Sacramento", "P") == ['"CAL AM - SUBURBAN ROSEMONT" water rates California', "SUBURBAN ROSEMONT California water rate schedule", "CAL AM - SUBURBAN ROSEMONT water utility rates fees California", '"CAL AM - SUBURBAN ROSEMONT" tariff rate schedule California filetype:pdf']
    assert of("FT COLLINS CITY OF", "co", None, "L") == ['"FT COLLINS CITY OF" water rates Colorado', "Fort Collins Colorado water rate schedule", "FT COLLINS CITY OF water utility rates fees Colorado", "FT COLLINS CITY OF water department rates Colorado"]
    assert of("STAFFORD CO UTIL", "VA", "Stafford", None)[1::2] == ["Stafford County Virginia water rate schedule", "Stafford county Virginia water rates"]


def test_scores_of_links(spark):
    link = lambda t, u="": one(spark, scores.link_score(F.lit(t), F.lit(u)))[0]
    assert link("Electric rates") == -2 and link("Electric rates of the water works") == 1
    assert link("Ordinance 5") == -2 and link("Ordinance 5 on fees and charges") == 0 and link("City budget", "https://x/DocumentCenter/View/1.pdf") == -2 + 1.5
    crawl = lambda label, u, level: one(spark, scores.crawl_score(F.lit(u), F.lit(label), F.lit(level)))[0]
    assert crawl("water", "https://x.gov/water", 1) == 25 + 15 and crawl("police", "https://x.gov/pd", 1) == 0
    assert crawl("here", "https://x.gov/f/tariff.pdf", 2) == 20 + 25 + 30 - 15 and crawl("agenda", "https://x.gov/a.pdf", 3) == 0
    older = lambda t, s, u: one(spark, scores.older_score(F.lit(t), F.lit(s), F.lit(u)))[0]
    assert older("Water Rates", "ccf", "https://a.gov/water-rates.pdf") == 2 * 3 + 3 + 2 * 2 + 1.5 and older("", "", "https://www.facebook.com/x") == -10
    local = lambda s, u, p, c=False: one(spark, scores.local_score(F.lit(s), F.lit(u), F.lit(p), F.lit(c)))[0]
    assert (local(40, "https://www.clearlake.ca.gov/x", "Clear Lake"), local(40, "https://oz.gov", "Oz"), local(90, "https://clearlake.org", "Clear Lake"), local(5, "https://a.b", "Abcd", True)) == (60, 40, 100, 0)


def test_fingerprints(spark):
    array = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, scores.amount_tokens(array(1234.5, 0.4, 30.0), array(25, 12.0), array(0.07, 0.01)))[0] == sorted(["1234.50", "1,234.50", "1234.5", "30.00", "30", "12.00", "12", "0.07", "25.00", "25"][:-2])
    got = one(spark, scores.phrase_tokens(F.lit("Rates for La Porte, TX by the Pennsylvania-American Water Company. Monthly Service Charge")))[0]
    assert set(got) >= {"La Porte", "La Porte, TX", "Pennsylvania-American"} and "Monthly Service Charge" not in got and [len(x) for x in got] == sorted(map(len, got), reverse=True)
    f = one(spark, scores.fingerprint(F.lit("bill 1,234.50 in la porte"), F.array(F.lit("1,234.50"), F.lit("9.99")), F.array(F.lit("La Porte"))), scores.fingerprint(F.lit(None).cast("string"), F.array(F.lit("1")), F.array(F.lit("x"))))
    assert tuple(f[0]) == (6, 1, 1) and tuple(f[1]) == (0, 0, 0)


def test_priorities(spark):
    c = selection.PUBLISHED
    cases = {"efc_ar_2020": 5, "efc_nc_2025": 3, "efc_new_2030": 3, "tx_tml_2023": 8, "duke_nieps_10state": 8, "swrcb_ear_2020": 6, "swrcb_ear_2019": 3, "owrs": 5, "other": 5, "scraped_llm": 1}
    assert len(c.exact) == 31 and each(spark, "string", list(cases), lambda s: selection.priority_of(s, c.exact, c.prefixes, c.fallback)) == list(cases.values())


def test_outcomes_of_runs(spark):
    lengths = {"a": (150, 500), "b": (None, 900), "c": (100, 499), "d": (100, 200), "e": (300, 299), "f": (300, None), "g": (0, 0), "h": (200, 5000)}
    frame = lambda k: spark.createDataFrame([(i, v[k]) for i, v in lengths.items()], "id string, n int")
    got = {r["id"]: r["outcome"] for r in reconcile.compare_runs(frame(0), frame(1), "id", "n").collect()}
    assert got == dict(zip(lengths, ["recovered", "recovered", "improved", "unchanged", "degraded", "degraded", "unchanged", "unchanged"]))


def test_labels_have_values(spark):
    flags = quality.record_flags(F.lit("swrcb_ear_2022"), {"tier_1_limit_ccf": F.lit(10.0), "tier_2_limit_ccf": F.lit(748.5), "tier_3_limit_ccf": F.lit(999.0)}, F.lit(1.255), F.lit(250.5), F.lit("2014-05-01").cast("date"))
    issues = quality.parse_issues([F.lit(0.05), F.lit(51.5), F.lit(None).cast("double")], F.lit(600.0), F.lit(None).cast("string"))
    assert one(spark, flags, issues) == (["ear_tier_limit_inflated (tier_2_limit_ccf=748)", "bill_suspiciously_low ($1.25)", "fixed_charge_high ($250)", "stale_vintage (2014)"], ["tier_1_rate_too_low:0.05", "tier_2_rate_too_high:51.5", "fixed_charge_high:600.0", "confidence_failed"])


def test_triage_of_gaps(spark):
    gaps = spark.createDataFrame([(k, "NY" if k in "pq" else "CO") for k in "abcdpq"], "pwsid string, state_code string")
    long = "x" * 200
    rows = [("a", 1, "https://good.org/1", 300, None, "active"), ("a", 2, "https://good.org/2", 900, None, "active"), ("a", 3, "https://good.org/3", 999, "failed", "active"), ("a", 4, "https://bad.com/4", 9999, None, "active"), ("b", 5, "https://bad.com/5", 300, None, "active"), ("c", 6, "https://good.org/6", 300, "success", "active"), ("c", 7, "https://good.org/7", 300, None, "dead"), ("p", 8, "https://www.ny.gov/x", 300, "failed", "active"), ("q", 9, "https://www.ny.gov/y", 300, "failed", "active"), ("q", 10, "https://good.org/z", 300, "failed", "active")]
    registry = spark.createDataFrame([(k, i, u, long, n, p, s) for k, i, u, n, p, s in rows], "pwsid string, id int, url string, scraped_text string, last_content_length int, last_parse_result string, status string")
    got = {r["pwsid"]: (r["class"], r["reason"], r["id"]) for r in queues.gap_triage(gaps, registry, ["bad.com"]).collect()}
    assert got == {"a": ("submittable", None, 2), "b": ("blacklisted_only", "all_urls_blacklisted", None), "c": ("exhausted", "all_ranks_tried", None), "d": ("exhausted", "no_text_available", None), "p": ("ny_portal_only", "ny_portal_only", None), "q": ("exhausted", "all_ranks_tried", None)}


def test_names_with_a_word_in_common_stay_apart(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    pool = [word() for _ in range(40)]
    make = lambda: " ".join(dict.fromkeys([*(rng.choice(pool) for _ in range(rng.randrange(1, 4))), "LAKE"]))
    a, b = sorted({make() for _ in range(150)}), sorted({make() for _ in range(150)} | {"LAKE", "LAKE x"})
    got = {(r["__name"], r["__other"]) for r in names.similar_names(spark.createDataFrame([(x,) for x in a], "__name string"), spark.createDataFrame([(x,) for x in b], "__other string")).collect()}
    size = lambda s: sum(map(len, s))
    want = {(x, y) for x in a for y in b if size(set(x.split()) & set(y.split())) * 2 >= size(set(x.split()) | set(y.split())) and any(len(w) > 3 for w in set(x.split()) & set(y.split()))}
    assert got == want and len(want) > 150


def test_all_candidates_of_a_key_are_ranked(spark, tmp_path):
    from penstock.plans import reports

    at = "timestamp'2024-01-01'"
    spark.sql(f"select id event_id, {at} ts, 7L user_id, 'click' event_type, 29.0D + id value, '' props from range(8)").write.parquet(f"{tmp_path}/events.parquet")
    got = reports.ranked_candidates(spark, str(tmp_path)).orderBy("rank").collect()
    assert [(r.rank, r.id, r.score) for r in got] == [(k, 8 - k, 37.0 - k) for k in range(1, 8)]


def test_list_has_every_status_and_price_unless_asked(spark, tmp_path):
    from penstock.plans import reports

    spark.sql("select id o_orderkey, 10.0D * id o_totalprice, if(id % 2 = 0, 'O', 'F') o_orderstatus, '1-URGENT' o_orderpriority from range(1, 7)").write.parquet(f"{tmp_path}/orders.parquet")
    of = lambda **by: [r.o_orderkey for r in reports.filtered_list(spark, str(tmp_path), **by).collect()]
    assert of() == [6, 5, 4, 3, 2, 1] and of(segment="O", least=40.0) == [6, 4]


def test_spread_that_rounds_to_nothing_agrees(spark, tmp_path):
    import duckdb

    from penstock.plans import queries

    spark.sql("select k o_orderkey, 1L o_custkey, 100.0D o_totalprice, string(k) o_orderpriority, timestamp'1998-01-01' o_orderdate from range(2) t(k)").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"create view orders as from '{tmp_path}/orders.parquet/*.parquet'")
    want = con.sql(queries.ORACLE["agreement"]).fetchall()
    assert [tuple(r) for r in queries.agreement(spark, str(tmp_path)).collect()] == want == [(1, 2, 2, 100.0, 100.0, "<10% agree")]


def test_means_are_rounded_by_their_product(spark):
    rows = [("a", s, b, dt.date(2020, 1, 1), []) for s, b in (("x", 1.0), ("y", 1.01))]
    got = reconcile.variance(spark.createDataFrame(rows, "pwsid string, source string, bill double, vintage date, flags array<string>")).first()
    assert got.mean_bill == 1.0  # 1.005 times 100 is below 100.5
