"""Text, URL, identifier and date functions as queries over a URL registry, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as X
from ..functions.numbers import exact_round, fixed
from ..operators.quality import safe_number
from ..sources.readers import table
from .rates import REGISTRY

YEAR = 2024
WORDS = ["water", "sewer", "rate", "fee"]


def _registry(spark, d):
    return spark.sql(REGISTRY.replace("{text}", "string"), events=table(spark, d, "events"))


def _orders(spark, d, sql):
    return spark.sql(sql, orders=table(spark, d, "orders"))


def url_parts(spark, d):
    """STR-9, STR-8, STR-5, STR-7: host, domain, path, type, state and content hash of a URL."""
    u = F.col("url")
    return _registry(spark, d).select("id", X.host(u).alias("host"), X.base_domain(u).alias("domain"), X.path(u).alias("path"), X.content_type(u).alias("kind"), X.state_of_host(X.host(u)).alias("state"), F.sha2(u, 256).alias("sha"), X.slug(u, hyphen=True).alias("slug"), X.file_tag(u).alias("tag"))


def url_scores(spark, d):
    """TXT-6: relevance of a URL with title and snippet in all its layers."""
    r = _registry(spark, d)
    title = F.when(F.col("id") % 3 == 0, F.lit("Water Bill and Rate Study")).otherwise(F.concat(F.lit("Budget "), (F.lit(2015) + F.col("id") % 12).cast("string")))
    name, city, state = F.when(F.col("id") % 2 == 0, F.lit("Clear Lake")).otherwise(F.lit("Springfield Water District")), F.when(F.col("id") % 4 > 0, F.lit("Springfield")), F.when(F.col("id") % 3 > 0, F.lit("ca"))
    return r.select("id", X.url_score(F.col("url"), title, F.lit("fee schedule"), name, city, state, year=YEAR, aggregators=["facebook.com", "yelp.com"]).alias("score"))


#: Link texts and snippets of search results by the number of a row.
TITLES = """array('Water and Sewer Rate Schedule FY 2024 (PDF)', 'City Council Minutes, agenda and budget', 'Ordinance 12 amending water fees', 'Utility Billing', 'Fire safety and zoning', 'Electric rates of the water works', 'Gas tariff', 'here', 'Budget of the water rate study', 'Departments', 'Pay my bill', 'View rates', 'Current rates and fee schedule')[id % 13]"""
SNIPPETS = """array('monthly bill of 5 ccf', 'Water pricing and rate structure', 'nothing of use')[id % 3]"""


def link_scores(spark, d):
    """TXT-7, TXT-8, TXT-16, TXT-18, TXT-14: the other scores of URLs and links, and triage classes."""
    r = _registry(spark, d).select("*", F.expr(TITLES).alias("title"), F.expr(SNIPPETS).alias("snippet"))
    u, t = F.col("url"), F.col("title")
    base = X.url_score(u, t, F.col("snippet"), F.lit("Clear Lake"), F.lit("Clear Lake"), F.lit("CA"), year=YEAR, aggregators=["facebook.com", "yelp.com"])
    return r.select(
        "id", base.alias("base"), S.local_score(base, u, F.when(F.col("id") % 2 == 0, "Clear Lake").otherwise("Oz"), F.col("id") % 10 == 3).alias("local"), S.older_score(t, F.col("snippet"), u).alias("older"), S.link_score(t, u).alias("link"), S.crawl_score(u, t, F.lit(1)).alias("first"), S.crawl_score(u, t, F.lit(2)).alias("deep"),
        F.when(F.lower(u).rlike("rates?|fees?|tariff"), "relevant").when(F.lower(u).rlike("facebook|twitter"), "external").when(F.lower(u).rlike("agenda|minutes|calendar"), "navigation").otherwise("unknown").alias("class"),
    )


#: Texts of documents, some with notices and amounts around them.
TEXTS = """select doc_id k, case doc_id % 8 when 0 then '' when 1 then 'This domain may be for sale. ' || substring(text, 1, 300) when 2 then 'Residential water rate schedule per 1,000 gallons: tier 1 $3.25, tier 2 $4.50 per CCF. ' || text when 3 then 'Council meeting agenda. Sewer works. ' || text
  when 4 then '404 not found ' || substring(text, 1, 120) when 5 then text || ' Drought surcharge, monthly base $12.00 and service charge $7.50' when 6 then substring(text, 1, 400) else text end txt from {documents}"""


def _texts(spark, d):
    return spark.sql(TEXTS, documents=table(spark, d, "documents"))


def text_checks(spark, d):
    """TXT-5, TXT-9, TXT-10, TXT-11, TXT-17: boost, thin texts, reasons to skip, route and empty tables."""
    t = F.col("txt")
    return _texts(spark, d).select("k", X.content_boost(t).alias("boost"), X.thin(t, WORDS).alias("thin"), X.skip_reason(t).alias("skip"), X.model_route(t).alias("route"), X.empty_table(t, F.length(t)).alias("rendered"))


def text_parts(spark, d):
    """TXT-4: pages of a long text with amounts and words of rates."""
    pages = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("txt") / 300).cast("int") - 1, F.lit(0))), lambda k: F.substring(F.col("txt"), k * 300 + 1, F.lit(300)))
    return _texts(spark, d).filter("txt is not null").select("k", X.rate_pages(pages, WORDS, 3).alias("p")).select("k", F.length("p").alias("n"), F.sha2("p", 256).alias("sha"))


def fingerprints(spark, d):
    """TXT-13: amounts of orders and names in notes, sought in texts."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sort_array(F.collect_list(exact_round(F.col("o_totalprice") / 64))).alias("bills"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("Rates of La Porte, TX and "), F.col("c_mktsegment"), F.lit(" Water-Works by Clear Lake Water District "), F.col("c_name"), F.lit(". Service Fee")).alias("notes"), F.floor(F.abs("c_acctbal")).alias("charge"))
    r = c.join(o, "k", "left").select("k", S.amount_tokens(F.col("bills"), F.array(F.col("charge"), F.lit(25.0), F.lit(0.5)), F.array(F.lit(0.07), F.lit(3.5), F.lit(0.01))).alias("a"), S.phrase_tokens(F.col("notes")).alias("p"))
    text = F.concat(F.lit("la porte, tx charges $3.50 or 0.07 and "), F.coalesce(F.element_at("a", -1), F.lit("")), F.lit(" in clear lake water"))
    return r.withColumn("f", S.fingerprint(text, F.col("a"), F.col("p"))).select("k", F.array_join("a", " ").alias("amounts"), F.array_join("p", "; ").alias("phrases"), "f.score")


def scripted_pages(spark, d):
    """TXT-2: pages that a script would fill in, by their clean text."""
    p = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("<p>few</p>"), F.repeat(F.lit("<script>x</script>"), (F.col("page_id") % 9).cast("int")))).when(F.col("page_id") % 5 == 1, '<div id="react-root"></div>').otherwise(F.col("html")).alias("html"))
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<script.*?</script>", ""), r"<[^>]*>", "")
    return p.select("page_id", X.looks_scripted(F.col("html"), F.trim(body)).alias("scripted"))


def date_forms(spark, d):
    """DATE-1, DATE-2, DATE-5, DATE-6, QC-7: dates of texts in many forms."""
    o = _orders(spark, d, """select o_orderkey k, o_orderdate at, case o_orderkey % 9 when 0 then date_format(o_orderdate, 'yyyy-M-d') when 1 then date_format(o_orderdate, 'MM/dd/yyyy') when 2 then date_format(o_orderdate, 'M/d/yy') when 3 then date_format(o_orderdate, 'MMMM d, yyyy')
        when 4 then concat('effective ', 2001 + o_orderkey % 30) when 5 then cast(1990 + o_orderkey % 50 as string) when 6 then concat('2023-13-', o_orderkey % 40) when 7 then date_format(o_orderdate, 'MMM dd, yyyy') else 'soon' end a, case o_orderkey % 4 when 0 then cast(1995 + o_orderkey % 40 as string) when 1 then concat(2003 + o_orderkey % 9, '-', o_orderkey % 14) when 2 then date_format(o_orderdate, 'M/d/yyyy') else 'NA' end b from {orders}""")
    return o.select("k", X.dated(F.col("a")).cast("string").alias("a"), X.year_date(F.col("b")).cast("string").alias("b"), X.newer_year(F.concat(F.lit("from 2019 to "), F.col("a"), F.lit(" or 2031")), F.lit(2030)).alias("newer"), (F.date_trunc("day", "at") == F.col("at")).alias("midnight"), F.when(F.col("k") % 3 == 0, F.lit("$1,234.50")).when(F.col("k") % 3 == 1, F.lit(" n/a ")).otherwise(F.col("k").cast("string")).alias("raw")).withColumn("number", safe_number(F.col("raw"))).drop("raw")


#: Names of systems of many kinds, made of keys and segments.
NAMES = """select c_custkey k, case c_custkey % 4 when 0 then 'nc-' || cast(c_custkey as {text}) when 1 then cast(c_custkey as {text}) when 2 then '03-63-' || lpad(cast(c_custkey % 1000 as {text}), 3, '0') else 'abc-1x' end id,
  case c_custkey % 9 when 0 then 'CORNWALL-ON-HUDSON' when 1 then 'ISLE OF WIGHT ' || c_mktsegment when 2 then 'ST. LOUIS WTR DIST' when 3 then 'ACSA - EAST' when 4 then 'STAFFORD CO UTIL' when 5 then 'FT ' || c_mktsegment || ' CITY OF' when 6 then 'TOWN OF ' || c_mktsegment || ' - LAKE' when 7 then 'CAL AM - SUBURBAN ' || c_mktsegment else 'HRWD' end nm,
  case c_custkey % 3 when 0 then 'Prince William' when 1 then '' end county, case c_custkey % 4 when 0 then 'L' when 1 then 'P' end owner, case c_custkey % 5 when 0 then 'va' when 1 then 'ZZ' else 'CO' end state from {customer}"""


def name_forms(spark, d):
    """STR-4, STR-6, STR-10, STR-11, STR-12: identifiers, titles, candidate URLs, search texts, abbreviations."""
    c = spark.sql(NAMES.replace("{text}", "string"), customer=table(spark, d, "customer"))
    urls = X.candidate_urls(F.concat(X.slug(F.col("nm")), F.lit(".gov")), ["/rates", "/utilities/water"])
    queries = X.queries_of(F.col("nm"), F.col("state"), F.col("county"), F.col("owner"))
    return c.select("k", X.identifier(F.col("id"), F.lit("nc")).alias("id"), X.place_title(F.col("nm")).alias("title"), F.array_join(urls, " ").alias("urls"), F.array_join(queries, "; ").alias("queries"), X.expand(F.col("nm"), F.col("county")).alias("long"))


def categories(spark, d):
    """STR-3, STR-14, VIS-1: normal categories, formats and colours."""
    o = _orders(spark, d, "select o_orderkey k, o_totalprice v, case o_orderkey % 11 when 0 then ' Flat ' when 1 then 'Increasing Block' when 2 then 'tiered rates (inclining block), as of 2020' when 3 then 'Not Found' when 4 then 'sewer' when 5 then 'budget_based' when 6 then 'something rather long and odd, unlike any' when 7 then 'we were unable to determine it' when 8 then 'Flat_Rate' when 9 then '' end s from {orders}")
    kind = X.normal_category(F.col("s"), {"flat_rate": "flat", "increasing block": "increasing_block", "tiered rates (inclining block)": "increasing_block", "flat rate": "flat"})
    ramp = X.ramp(F.when(F.col("k") % 9 > 0, F.floor(F.col("v") / 1000)), [(0.0, (0, 0, 0)), (100.0, (200, 100, 50)), (200.0, (255, 255, 255))])
    return o.select("k", kind.alias("kind"), X.compact(F.floor(F.col("v") / 100) * 100 + 1).alias("short"), X.percent(F.floor(F.col("v") / 4000) / 2).alias("pct"), ramp.alias("colour"))


def exact_rounding(spark, d):
    """Rounding of the exact binary value, halves to even, as the surveyed code's bills are rounded."""
    v = F.col("l_extendedprice") / F.array(F.lit(8.0), F.lit(40.0), F.lit(1000.0), F.lit(200.0))[F.col("l_linenumber") % 4]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", exact_round(v).alias("v"), fixed(-v, 1).alias("t"))


QUERIES = {f.__name__: f for f in (url_parts, url_scores, link_scores, text_checks, text_parts, fingerprints, scripted_pages, date_forms, name_forms, categories, exact_rounding)}

_R = "with r as (" + REGISTRY.format(text="varchar", events="events") + "), h as (select *, lower(regexp_extract(url, 'https://([^/]+)', 1)) host from r)"
_T = "with t as (" + TEXTS.format(documents="documents") + ")"
_DOLLAR = r"\$\s*\d+\.\d{2}"
_SEG = "['" + "','".join(X.SEGMENTS) + "']"
_HAS = lambda words, c: " + ".join(f"contains({c}, '{w}')::int" for w in words)


_ABBR = "cl"
for _pattern, _words in X.ABBREVIATIONS:
    _ABBR = f"regexp_replace({_ABBR}, '{_pattern}', '{_words}', 'g')"


def _hit(pattern: str) -> str:
    """A pattern's test in SQL: words that may not follow are sought behind its last place."""
    head, *never = pattern.replace("(?!.*", "\0").replace(")\0", "\0").rstrip(")").split("\0") if "(?!" in pattern else [pattern]
    return f"regexp_matches(lt, '{head}')::int" if not never else f"(regexp_matches(lt, '{head}') and not regexp_matches(regexp_extract(lt, '.*{head}(.*)', 1), '{'|'.join(never)}'))::int"


_HITS = lambda patterns: " + ".join(map(_hit, patterns))
_WEIGH = lambda words: " + ".join(f"{p} * ({_HAS(w, 'c')})" for p, w in words.items())
_STATE = "case when host like '%.ca.gov' then 'CA' end"
ORACLE = {
    "url_parts": _R + f""" select id, host, regexp_extract(host, '([^.]+[.][^.]+)$', 1) "domain", regexp_extract(url, 'https://[^/]+([^?]*)', 1) "path", case when url like '%.pdf' then 'pdf' else 'html' end kind, {_STATE} state, sha256(url) sha, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') slug, left(regexp_replace(url, '[^A-Za-z0-9_-]+', '_', 'g'), 40) tag from h""",
    "url_scores": _R + f""", p as (select *, case when id % 3 = 0 then 'water bill and rate study' else 'budget ' || (2015 + id % 12) end title, case when id % 3 = 0 then null else 2015 + id % 12 end ty from h), q as (select *, lower(url) || ' ' || title || ' fee schedule' txt, greatest(ty, case when url like '%/2019/%' then 2019 end) y from p),
        s as (select id, 15 * ({_HAS(X.RATE_WORDS, 'txt')}) + case when host like '%.gov%' then 15 when host like '%.org%' then 10 when host like '%.us%' then 8 else 0 end - case when host like '%facebook.com%' then 25 else 0 end
          + case when id % 2 = 0 and host like '%clearlake%' then 25 when id % 2 = 0 and host like '%clear%' then 15 when id % 2 = 1 and host like '%springfield%' then 15 else 0 end + case when id % 4 > 0 and host like '%springfield%' then 15 else 0 end
          + case when url like '%.pdf' then 20 else 0 end + case when url like '%/Fees' then 20 when url like '%/water-rates.pdf' then 15 else 0 end
          + case when y is null then 0 when y >= 2024 then 10 when y = 2023 then 5 else greatest(-5 * (2024 - y - 2), -15) end - 20 * ({_HAS(X.BAD_WORDS, 'txt')}) v from q) select id, greatest(0, least(100, v))::int score from s""",
    "link_scores": _R + f""", q as (select *, {TITLES.replace('array(', '[').replace(')[id % 13]', '][id % 13 + 1]')} title, {SNIPPETS.replace('array(', '[').replace(')[id % 3]', '][id % 3 + 1]')} snippet, lower(url) lu from h), p as (select *, lower(title) lt, lu || ' ' || title c, lu || ' ' || lower(title || ' ' || snippet) txt, list_max([z::int for z in regexp_extract_all(lu || title || snippet, '20(1[5-9]|2[0-9])', 1)]) + 2000 y from q),
        b as (select *, greatest(0, least(100, 15 * ({_HAS(X.RATE_WORDS, 'txt')}) + case when host like '%.gov%' then 15 when host like '%.org%' then 10 when host like '%.us%' then 8 else 0 end - case when host like '%facebook.com%' or host like '%yelp.com%' then 25 else 0 end + case when host like '%clearlake%' then 40 when host like '%clear%' then 15 else 0 end
          + case when lu like '%.pdf' and ({_HAS(['rate', 'schedule', 'fee', 'tariff'], 'txt')}) > 0 then 20 else 0 end + case when url like '%/Fees' then 20 when url like '%/water-rates.pdf' then 15 else 0 end + case when y is null then 0 when y >= 2024 then 10 when y = 2023 then 5 else greatest(-5 * (2024 - y - 2), -15) end - 20 * ({_HAS(X.BAD_WORDS, 'txt')})))::int base from p)
        select id, base, greatest(0, least(100, base + case when id % 2 = 0 and host like '%clearlake%' then 20 else 0 end - case when id % 10 = 3 then 15 else 0 end))::int "local",
        (2 * ({_HAS(S.OLDER_WORDS, "lower(title || ' ' || snippet)")}) + case when host like '%.gov' then 3 when host like '%.org' then 1.5 else 0 end - 10 * ({_HAS(S.OLDER_BAD, 'host')}) + 2 * ({_HAS(S.OLDER_TERMS, 'lu')}) + case when lu like '%.pdf' then 1.5 else 0 end)::double older,
        (3 * ({_HITS(S.STRONG)}) + ({_HITS(S.MODERATE)}) - 2 * ({_HITS(S.NEGATIVE)}) + case when lu like '%documentcenter%' then 1 else 0 end + case when lu like '%.pdf%' or lt like '%(pdf)%' then 0.5 else 0 end)::double link,
        greatest(0, {_WEIGH(S.FIRST_WORDS)} + 15 * ({_HAS(S.FIRST_PATHS, 'lu')}))::int "first",
        greatest(0, {_WEIGH(S.DEEP_WORDS)} + case when lu like '%.pdf' then case when ({_HAS(S.DEEP_PDF, 'c')}) > 0 then 30 when {_WEIGH(S.DEEP_WORDS)} > 0 then 15 else 0 end else 0 end + {_WEIGH(S.DEEP_MORE)} - case when lt in ({", ".join(repr(x) for x in S.EMPTY_LINKS)}) then 15 else 0 end)::int deep,
        case when url like '%rates%' or url like '%Fees%' then 'relevant' when url like '%facebook%' then 'external' when url like '%agenda%' then 'navigation' else 'unknown' end "class" from b""",
    "text_checks": _T + f""", s as (select *, lower(txt) l, length(txt) n, case when length(txt) > 10000 then lower(left(txt, 5000) || right(txt, 5000)) else lower(txt) end m, trim(coalesce(txt, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || ' ') bare from t), p as (select *, lower(bare) lb, length(bare) nb, [x for x in {X.PARKED} if contains(lower(bare), x)][1] sign from s)
        select k, case when coalesce(n, 0) < 200 then 0 else greatest(-15, least(20, case when contains(m, 'per 1,000') or contains(m, 'per thousand') then 8 else 0 end + case when contains(m, 'ccf') then 6 else 0 end + case when contains(m, '/1000 gal') or contains(m, 'per 1000 gal') then 6 else 0 end + case when contains(m, 'residential') and (contains(m, 'rate') or contains(m, 'charge')) then 4 else 0 end
          + case when {_HAS(X.TIER_SIGNS, 'm')} >= 2 then 5 else 0 end - case when contains(m, 'sewer') and not contains(m, 'water rate') then 10 else 0 end - case when contains(m, 'meeting') and contains(m, 'agenda') then 10 else 0 end - case when contains(m, '404') and contains(m, 'not found') then 15 else 0 end)) end::int boost,
        n < 2000 and ({_HAS(WORDS, 'l')}) < 2 and not regexp_matches(txt, '{_DOLLAR}') thin,
        case when bare = '' then 'empty_content' when nb < 100 then 'too_short (' || nb || ' chars)' when sign is not null then 'parked_domain (' || sign || ')' when nb < 500 and {_HAS(X.UTILITY_WORDS, 'lb')} = 0 then 'short_no_water_keywords (' || nb || ' chars)' when not regexp_matches(txt, '[$][0-9]') and {_HAS(X.MONEY_WORDS, 'lb')} = 0 then 'no_financial_or_rate_content' end skip,
        case when n > 10000 or {_HAS(X.ROUTE_WORDS, 'l')} > 6 or {_HAS(X.ROUTE_SIGNS, 'l')} > 0 then 'large' else 'small' end route,
        case when regexp_matches(txt, '{X.TABLE_SIGNS}') and len(regexp_extract_all(txt, '[$][0-9]+[.][0-9][0-9]')) < 3 then 'js_table_empty' when n < 500 then 'thin_page' end rendered from p""",
    "text_parts": _T + f""", p as (select k, txt, unnest(range(0, greatest((length(txt) + 299) // 300, 1))) i from t where txt is not null), g as (select k, i, substring(txt, i * 300 + 1, 300) s from p), c as (select *, i >= 2 and regexp_matches(s, '{_DOLLAR}') and ({_HAS(WORDS, 'lower(s)')}) > 0 good from g),
        n as (select *, sum(good::int) over (partition by k order by i) nth from c), r as (select k, string_agg(s, chr(10) || chr(10) order by i) p from n where i < 2 or (good and nth <= 3) group by 1) select k, length(p)::int n, sha256(p) sha from r""",
    "fingerprints": """with b as (select o_custkey k, format('{:.2f}', o_totalprice / 64)::double v, 0.5 least from orders union all select c_custkey, floor(abs(c_acctbal)), 0.5 from customer union all select c_custkey, v, 0.05 from customer, (values (0.07), (3.5)) q(v) union all select c_custkey, 25, 0.5 from customer),
        f as (select distinct k, unnest([format('{:.2f}', v::double), case when v >= 1000 then format('{:,.2f}', v::double) end, case when format('{:.2f}', v::double) like '%0' then regexp_replace(format('{:.2f}', v::double), '[.]?0+$', '') end, case when v = floor(v) and v >= 10 then v::bigint::varchar end]) a from b where v > least),
        a as (select k, list(a order by a) a from f where a is not null and a not in ('5.00', '10.00', '15.00', '20.00', '25.00', '50.00', '100.00', '1.00', '2.00', '3.00', '5', '10', '15', '20', '25', '50', '100') group by 1),
        p as (select c_custkey k, 'Rates of La Porte, TX and ' || c_mktsegment || ' Water-Works by Clear Lake Water District ' || c_name || '. Service Fee' n from customer),
        g as (select k, unnest([z for z in regexp_extract_all(n, '\\b[A-Z][a-zA-Z]+(?:[\\s\\-][A-Z][a-zA-Z]+){1,4}\\b') if length(z) >= 6 and len([w for w in string_split(z, ' ') if lower(w) not in ('water', 'rates', 'service', 'fee')]) > 0] || regexp_extract_all(n, '\\b[A-Z][a-z]+-[A-Z][a-z]+(?:-[A-Z][a-z]+)*\\b') || regexp_extract_all(n, '\\b[A-Z][a-zA-Z]+(?:\\s[A-Z][a-zA-Z]+)?,\\s[A-Z]{2}\\b')
          || [split_part(z, ',', 1) for z in regexp_extract_all(n, '\\b[A-Z][a-zA-Z]+(?:\\s[A-Z][a-zA-Z]+)?,\\s[A-Z]{2}\\b') if length(split_part(z, ',', 1)) >= 4]) z from p), h as (select k, list(z order by -length(z), z) p from (select distinct k, z from g) group by 1),
        x as (select k, a, p, 'la porte, tx charges $3.50 or 0.07 and ' || a[-1] || ' in clear lake water' t from a join h using (k))
        select k, array_to_string(a, ' ') amounts, array_to_string(p, '; ') phrases, (len([z for z in a if contains(t, z)]) + 5 * len([z for z in p if contains(t, z) or contains(lower(t), lower(z))]))::int score from x""",
    "scripted_pages": """with p as (select page_id, case page_id % 5 when 0 then '<p>few</p>' || repeat('<script>x</script>', (page_id % 9)::int) when 1 then '<div id="react-root"></div>' else html end html from pages), q as (select *, trim(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '<[^>]*>', '', 'g')) body from p)
        select page_id, length(body) < 200 and (len(string_split(html, '<script')) - 1 > 5 or contains(html, '__NEXT_DATA__') or contains(html, 'react-root') or contains(html, 'ng-app') or contains(html, 'vue-app') or contains(html, '#app')) scripted from q""",
    "date_forms": """select o_orderkey k, case o_orderkey % 9 when 4 then make_date(2001 + o_orderkey % 30, 1, 1) when 5 then make_date(1990 + o_orderkey % 50, 1, 1) when 6 then date '2023-01-01' when 8 then null else coalesce(try_strptime(case when o_orderkey % 9 = 2 then strftime(o_orderdate, '%-m/%-d/%Y') else strftime(o_orderdate, '%Y-%m-%d') end, ['%m/%d/%Y', '%Y-%m-%d']), null) end::date::varchar a,
        case o_orderkey % 4 when 0 then case when 1995 + o_orderkey % 40 between 2000 and 2030 then make_date(1995 + o_orderkey % 40, 1, 1) end when 1 then case when o_orderkey % 14 between 1 and 12 then make_date(2003 + o_orderkey % 9, o_orderkey % 14, 1) end when 2 then o_orderdate end::date::varchar b,
        greatest(2031, case when o_orderkey % 9 = 5 then 1990 + o_orderkey % 50 when o_orderkey % 9 = 4 then 2001 + o_orderkey % 30 end)::int newer, o_orderdate = o_orderdate::date midnight, case o_orderkey % 3 when 0 then 1234.5 when 1 then null else o_orderkey end::double number from orders""",
    "name_forms": "with c as (" + NAMES.format(text="varchar", customer="customer") + rf"""), e as (select *, trim(regexp_replace(nm, '(?i)\s*[-–]\s*(EAST|WEST|NORTH|SOUTH|CENTRAL|MAIN|PRIMARY)\s*$', '')) cl from c), f as (select *, regexp_extract(split_part(cl, '-', 1), '^\s*(\S+)', 1) w1, len([x for x in string_split(cl, ' ') if x <> '']) nw from e),
        g as (select *, case when length(w1) <= 5 and upper(w1) = w1 and regexp_matches(w1, '[A-Z]') and county <> '' and nw <= 3 then case when w1 like '%SA' or w1 like '%CA' then county || ' County Service Authority' when w1 like '%SD' or w1 like '%WD' then county || ' Water District' else county || ' County Water' end else {_ABBR} end best,
          case upper(state) when 'VA' then 'Virginia' when 'CO' then 'Colorado' else state end sf, nullif(county, '') cy, case when contains(nm, ' - ') then trim(substring(nm, position(' - ' in nm) + 3)) end area from f),
        v as (select *, coalesce(nullif(array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split(trim(regexp_extract(nm, '(?i)^(?:CITY|TOWN|VILLAGE)\s+OF\s+(.+?)(?:\s*[-,]|$)', 1)), ' ')], ' '), ''), nullif(regexp_replace(array_to_string([upper(x[1]) || lower(x[2:]) for x in string_split(trim(regexp_extract(nm, '(?i)^(.+?)\s+(?:CITY|TOWN|VILLAGE)\s+OF\s*$', 1)), ' ')], ' '), '\bFt\b', 'Fort'), '')) town, case when area is not null then nm else best end whole from g)
        select k, case when upper(id) like 'NC%' then upper(replace(replace(id, '-', ''), ' ', '')) when regexp_matches(replace(id, '-', ''), '^[0-9]+$') then 'NC' || replace(id, '-', '') else upper(id) end id,
        array_to_string([array_to_string([case when i > 1 and lower(w) in ('on', 'of', 'the', 'in', 'at', 'de', 'du', 'le', 'la') then lower(w) else upper(w[1]) || lower(w[2:]) end for w, i in [x for x in string_split(p, ' ') if x <> '']], ' ') for p in string_split(nm, '-')], '-') title,
        'https://' || regexp_replace(lower(nm), '[^a-z0-9]', '', 'g') || '.gov/rates https://' || regexp_replace(lower(nm), '[^a-z0-9]', '', 'g') || '.gov/utilities/water' urls,
        concat_ws('; ', '"' || whole || '" water rates ' || sf, coalesce(area, town, cy || ' County') || ' ' || sf || ' water rate schedule', best || ' water utility rates fees ' || sf,
          case when owner = 'P' then '"' || whole || '" tariff rate schedule ' || sf || ' filetype:pdf' when area is not null then best || ' "' || area || '" water rates ' || sf when cy is not null then cy || ' county ' || sf || ' water rates' else best || ' water department rates ' || sf end) queries, best long from v""",
    "categories": r"""with o as (select o_orderkey k, o_totalprice v, floor(o_totalprice / 1000) x, floor(o_totalprice / 100) * 100 + 1 w from orders), c as (select *, case when x < 100 then 0 + 200 * x / 100 else 200 + 55 * (x - 100) / 100 end r, case when x < 100 then 100 * x / 100 else 100 + 155 * (x - 100) / 100 end g, case when x < 100 then 50 * x / 100 else 50 + 205 * (x - 100) / 100 end b from o)
        select k, case k % 11 when 0 then 'flat' when 1 then 'increasing_block' when 2 then 'increasing_block' when 5 then 'budget_based' when 8 then 'flat' end kind,
        case when w >= 1000000 then format('{:.1f}M', w / 1e6) when w >= 1000 then format('{:.1f}K', w / 1e3) else format('{:.0f}', w) end short, format('{:.1f}%', floor(v / 4000) / 2) pct,
        case when k % 9 = 0 then '#cccccc' when x >= 200 then '#ffffff' else '#' || lpad(lower(to_hex(round(r)::int)), 2, '0') || lpad(lower(to_hex(round(g)::int)), 2, '0') || lpad(lower(to_hex(round(b)::int)), 2, '0') end colour from c""",
    "exact_rounding": "with l as (select *, l_extendedprice / [8.0::double, 40.0::double, 1000.0::double, 200.0::double][l_linenumber % 4 + 1] x from lineitem) select l_orderkey, l_linenumber, l_extendedprice, format('{:.2f}', x)::double v, format('{:.1f}', -x) t from l",
}
