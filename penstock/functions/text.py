"""Text, URL, identifier and date expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sections import let

#: Postal codes and names of the states.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas",
    "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico",
    "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia",
    "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming", "DC": "District of Columbia",
}
#: Words of the URL and content scores.
RATE_WORDS = ["rate", "schedule", "tariff", "water bill", "fee schedule", "rate structure", "charges", "pricing", "rate study"]
BAD_WORDS = ["meeting", "agenda", "minutes", "news", "press release", "election", "job", "career", "bid", "rfp"]
GENERIC = ["water", "city", "town", "county", "district", "authority", "department", "service", "system", "utility", "utilities", "board"]
SEGMENTS = ["rates", "rate-schedule", "water-rates", "billing-rates", "fees", "rate-structure", "utility-rates", "water-sewer-rates", "rates-fees", "rates-and-fees", "tariff", "rate-table", "water-and-sewer-rates", "fee-schedule"]
TIER_SIGNS = ["tier 1", "tier 2", "tier 3", "block 1", "block 2", "first tier", "second tier", "0 - ", "0-"]
ROUTE_WORDS = ["tier", "block", "step", "level", "ccf", "gallons", "1,000", "usage charge"]
ROUTE_SIGNS = ["budget-based", "drought", "seasonal", "surcharge", "cpuc", "allocation", "baseline", "customized", "water budget"]
#: An amount of dollars and cents.
DOLLARS = r"\$\s*\d+\.\d{2}"


def count_of(text: Column, words: list[str]) -> Column:
    """How many of the words stand in the text."""
    return reduce(lambda a, b: a + b, [F.when(text.contains(w), 1).otherwise(0) for w in words])


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def points(*parts: tuple[Column, float]) -> Column:
    """Sum of the points whose condition holds; a null condition doesn't."""
    return reduce(lambda a, b: a + b, [F.when(c, p).otherwise(0) for c, p in parts])


def between(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def slug(text: Column, hyphen: bool = False) -> Column:
    """Lower case letters and digits; with ``hyphen`` other runs become one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "") if hyphen else F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def file_tag(text: Column) -> Column:
    """A text as part of a file name."""
    return F.left(F.regexp_replace(text, r"[^A-Za-z0-9_-]+", "_"), F.lit(40))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-z]+://(?:[^/@]*@)?([^/:?#]*)", 1))


def base_domain(url: Column) -> Column:
    """The last two labels of the host."""
    return F.concat_ws(".", F.slice(F.split(host(url), r"\."), F.greatest(F.size(F.split(host(url), r"\.")) - 1, F.lit(1)), F.lit(2)))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def content_type(url: Column) -> Column:
    p = F.lower(path(url))
    return F.when(p.endswith(".pdf"), "pdf").when(p.rlike(r"\.xlsx?$"), "excel").otherwise("html")


def state_of_host(name: Column) -> Column:
    """The state that a .gov or .us host names before its last label, by code or (gov) in full."""
    parts = F.split(F.lower(name), r"\.")
    label, last = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))
    full = F.create_map(*[F.lit(x) for k, v in STATES.items() for x in (v.lower(), k)])
    code = F.when(F.upper(label).isin(*STATES), F.upper(label))
    return F.when((F.size(parts) >= 3) & (last == "gov"), F.coalesce(code, F.try_element_at(full, label))).when((F.size(parts) >= 3) & (last == "us"), code)


def path_points(url: Column) -> Column:
    """20 for a path segment that rate pages have, 15 for a file of such a name."""
    p = F.regexp_replace(F.regexp_replace(F.lower(path(url)), "_", "-"), "%20", "-")
    segments = F.split(p, "/")
    stem = F.regexp_replace(F.element_at(segments, -1), r"\.[^.]*$", "")
    return F.when(F.arrays_overlap(segments, F.array(*[F.lit(s) for s in SEGMENTS])), 20).when(stem.isin(SEGMENTS), 15).otherwise(0)


def freshness_points(text: Column, year: int) -> Column:
    """By the latest year named (2015 to 2029): 10 for this one, 5 for the last, then falling to -15; 0 without one."""
    latest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"20(1[5-9]|2[0-9])"), F.lit(1)), lambda y: y.cast("int") + 2000))
    return F.when(latest.isNull(), 0).when(latest >= year, 10).when(latest == year - 1, 5).otherwise(F.greatest(-5 * (F.lit(year) - latest - 2), F.lit(-15)))


def url_score(url: Column, title: Column, snippet: Column, name: Column, city: Column, state: Column, *, year: int, aggregators: list[str]) -> Column:
    """Relevance 0 to 100: words, domain, names in the host, file type, path, freshness, bad words, another state's host."""
    return let(F.lower(F.concat_ws(" ", url, title, snippet)), lambda text: let(host(url), lambda h: _url_score(text, h, url, name, city, state, year, aggregators)))


def _url_score(text: Column, h: Column, url: Column, name: Column, city: Column, state: Column, year: int, aggregators: list[str]) -> Column:
    whole = slug(name)
    bare = F.regexp_replace(F.replace(h, F.lit("www."), F.lit("")), "[^a-z0-9]", "")
    words = F.filter(F.split(F.lower(name), " +"), lambda w: (F.length(w) > 4) & ~w.isin(GENERIC))
    in_name = F.when((F.length(whole) > 5) & bare.contains(whole), 25).when(F.exists(words, lambda w: h.contains(w)), 15).otherwise(0)
    there = state_of_host(h)
    total = (
        15 * count_of(text, RATE_WORDS)
        + F.when(h.contains(".gov"), 15).when(h.contains(".org"), 10).when(h.contains(".us"), 8).otherwise(0)
        + points((has_any(h, aggregators), -25), ((F.length(slug(city)) > 3) & h.contains(slug(city)), 15), (F.lower(url).endswith(".pdf") & has_any(text, ["rate", "schedule", "fee", "tariff"]), 20), (there != F.upper(state), -40))
        + F.coalesce(in_name, F.lit(0))
        + path_points(url)
        + freshness_points(text, year)
        - 20 * count_of(text, BAD_WORDS)
    )
    return between(total, 0, 100).cast("int")


def content_boost(text: Column) -> Column:
    """-15 to 20 by signs of a rate table in the first and last 5000 characters; 0 for texts under 200."""
    sample = F.lower(F.when(F.length(text) > 10_000, F.concat(F.left(text, F.lit(5000)), F.right(text, F.lit(5000)))).otherwise(text))

    def of(t: Column) -> Column:
        has = t.contains
        return points(
            (has("per 1,000") | has("per thousand"), 8), (has("ccf"), 6), (has("/1000 gal") | has("per 1000 gal"), 6), (has("residential") & (has("rate") | has("charge")), 4), (count_of(t, TIER_SIGNS) >= 2, 5),
            (has("sewer") & ~has("water rate"), -10), (has("meeting") & has("agenda"), -10), (has("404") & has("not found"), -15),
        )

    boost = let(sample, of)
    return F.when(F.coalesce(F.length(text), F.lit(0)) < 200, 0).otherwise(between(boost, -15, 20)).cast("int")


def thin(text: Column, words: list[str]) -> Column:
    """Under 2000 characters, fewer than two keywords and no amount of dollars."""
    return (F.length(text) < 2000) & let(F.lower(text), lambda t: count_of(t, words) < 2) & ~text.rlike(DOLLARS)


#: Signs of a parked or default page, words of a utility, words of rates.
PARKED = ["domain is for sale", "buy this domain", "this domain may be for sale", "parked domain", "coming soon", "under construction", "website coming soon", "page not found", "this site is temporarily unavailable", "default web page", "welcome to nginx", "apache2 default page", "it works!", "index of /", "godaddy", "parking page"]
UTILITY_WORDS = ["water", "utility", "sewer", "rate", "fee", "billing", "customer", "service"]
MONEY_WORDS = ["rate", "tariff", "fee schedule", "water charge", "service charge", "per 1,000", "per thousand", "ccf", "hcf", "kgal", "gallons", "volumetric", "tier", "base charge", "fixed charge", "monthly charge", "billing", "usage charge"]


def skip_reason(text: Column) -> Column:
    """Why a text isn't worth parsing, null if it may be: empty, under 100 characters, parked, short without a word of utilities, without an amount and a word of rates."""
    size = lambda t: F.length(t).cast("string")

    def of(t: Column) -> Column:
        sign = F.coalesce(*[F.when(t.contains(w), F.lit(w)) for w in PARKED])
        return (
            F.when(F.length(t) < 100, F.concat(F.lit("too_short ("), size(t), F.lit(" chars)"))).when(sign.isNotNull(), F.concat(F.lit("parked_domain ("), sign, F.lit(")")))
            .when((F.length(t) < 500) & ~has_any(t, UTILITY_WORDS), F.concat(F.lit("short_no_water_keywords ("), size(t), F.lit(" chars)"))).when(~text.rlike(r"\$\d") & ~has_any(t, MONEY_WORDS), "no_financial_or_rate_content")
        )

    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return let(bare, lambda t: F.when(t == "", "empty_content").otherwise(let(F.lower(t), of)))


def model_route(text: Column, large: str = "large", small: str = "small") -> Column:
    """The larger model for long texts, many tier words or signs of complexity."""
    return let(F.lower(text), lambda t: F.when((F.length(text) > 10_000) | (count_of(t, ROUTE_WORDS) > 6) | has_any(t, ROUTE_SIGNS), large).otherwise(small))


#: Marks of frameworks that fill pages by script, and signs of a rate table.
FRAMEWORKS = ["__NEXT_DATA__", "react-root", "ng-app", "vue-app", "#app"]
TABLE_SIGNS = r"(?i)(water\s+volume|per\s+1,?000|tier\s+\d|rate\s+schedule|monthly\s+base|service\s+charge|meter\s+size)"


def looks_scripted(html: Column, text: Column) -> Column:
    """Whether a page of under 200 characters of text has over five script tags or a framework's mark."""
    return (F.length(text) < 200) & ((F.size(F.split(html, "<script")) - 1 > 5) | has_any(html, FRAMEWORKS))


def empty_table(text: Column, length: Column) -> Column:
    """js_table_empty where a rate table is announced and fewer than three amounts stand, else thin_page where a page had under 500 characters; null for others."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike(TABLE_SIGNS) & (F.regexp_count(t, F.lit(r"\$\d+\.\d{2}")) < 3), "js_table_empty").when(length < 500, "thin_page")


def rate_pages(pages: Column, words: list[str], most: int = 30) -> Column:
    """Of an array of pages the first two and those with an amount and a keyword, ``most`` of these, joined by blank lines."""
    numbered = F.transform(pages, lambda p, k: F.struct(k.alias("k"), p.alias("p")))
    good = F.slice(F.filter(numbered, lambda x: (x["k"] >= 2) & x["p"].rlike(DOLLARS) & has_any(F.lower(x["p"]), words)), 1, most)
    return F.array_join(F.transform(F.concat(F.slice(numbered, 1, 2), good), lambda x: x["p"]), "\n\n")


def dated(text: Column) -> Column:
    """A date of one of the usual forms, with months and days of one digit or two, else January 1 of a year 20xx in the text, else null.

    Years of two digits from 69 on are of the last century. Months are named in full or by three letters.
    """
    t = F.trim(text)
    part = lambda p, k: F.regexp_extract(t, p, k).try_cast("int")
    day = lambda y, m, d: F.when((y >= 1) & m.between(1, 12) & (d >= 1) & (d <= F.dayofmonth(F.last_day(F.make_date(y, m, F.lit(1))))), F.make_date(y, m, d))
    months = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
    iso, us, short, named = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{1,2})/(\d{1,2})/(\d{2})$", r"^([A-Za-z]{3,9})\s+(\d{1,2}),\s*(\d{4})$"
    word = F.lower(F.regexp_extract(t, named, 1))
    number = F.coalesce(*[F.when(word.isin(m, m[:3]), F.lit(k)) for k, m in enumerate(months, 1)])
    two = part(short, 3)
    known = (
        F.when(t.rlike(iso), day(part(iso, 1), part(iso, 2), part(iso, 3))).when(t.rlike(us), day(part(us, 3), part(us, 1), part(us, 2))).when(t.rlike(short), day(F.when(two >= 69, two + 1900).otherwise(two + 2000), part(short, 1), part(short, 2)))
        .when(t.rlike(named), day(part(named, 3), number, part(named, 2))).when(t.rlike(r"^\d{4}$"), day(t.try_cast("int"), F.lit(1), F.lit(1)))
    )
    year = F.regexp_extract(t, r"(20\d{2})", 1)
    # what isn't a digit or a letter first has no form but may name a year
    return F.coalesce(F.when(t.rlike(r"^[0-9A-Za-z]"), known), F.when(year != "", F.make_date(year.try_cast("int"), F.lit(1), F.lit(1))))


def year_date(text: Column) -> Column:
    """January 1 of a year 2000 to 2030, a month of the form yyyy-m, or a date of the form mm/dd/yyyy."""
    number = F.trim(text).try_cast("int")
    month = F.regexp_extract(text, r"^(\d{4})-(\d{1,2})$", 2).try_cast("int")
    return F.coalesce(F.when(number.between(2000, 2030), F.make_date(number, F.lit(1), F.lit(1))), F.when(month.between(1, 12), F.make_date(F.left(text, F.lit(4)).try_cast("int"), month, F.lit(1))), F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(text, "M/d/yyyy")))


def newer_year(text: Column, known: Column) -> Column:
    """The latest year of a text after a known one; null without one."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b(20[0-9]{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.array_max(F.filter(years, lambda y: y > known))


def identifier(text: Column, state: Column) -> Column:
    """A system id: with its state's letters, without dashes and blanks; digits get the state's letters, other texts are upper case; null for NA, None and empty texts."""
    t, st = F.trim(text), F.upper(state)
    bare = F.regexp_replace(t, "[- ]", "")
    return F.when((t == "") | t.isin("NA", "None"), None).when(F.startswith(F.upper(t), st), F.upper(bare)).when(bare.rlike(r"^\d+$"), F.concat(st, bare)).otherwise(F.upper(t))


#: Words that stay small behind the first of a part.
SMALL = ["on", "of", "the", "in", "at", "de", "du", "le", "la"]


def place_title(text: Column) -> Column:
    """Title case by hyphenated part: words have a capital, but the small ones behind a part's first word."""
    capital = lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1000)))
    words = lambda p: F.filter(F.split(p, r"\s+"), lambda w: w != "")
    part = lambda p: F.array_join(F.transform(words(p), lambda w, k: F.when((k > 0) & F.lower(w).isin(SMALL), F.lower(w)).otherwise(capital(w))), " ")
    return F.array_join(F.transform(F.split(text, "-"), lambda p: part(p)), "-")


#: Abbreviations in upper case and what they stand for, in order.
ABBREVIATIONS = [
    (r"\bCO\b", "County"), (r"\bCTY\b", "County"), (r"\bUTIL(?:S)?\b", "Utilities"), (r"\bSVC\b", "Service"), (r"\bAUTH\b", "Authority"), (r"\bDEPT\b", "Department"), (r"\bDIST\b", "District"), (r"\bWTR\b", "Water"), (r"\bW/S\b", "Water and Sewer"),
    (r"\bCOMM\b", "Commission"), (r"\bTWP\b", "Township"), (r"\bBORO\b", "Borough"), (r"\bMUN\b", "Municipal"), (r"\bPSA\b", "Public Service Authority"), (r"\bWSA\b", "Water and Sewer Authority"),
]


def expand(name: Column, county: Column) -> Column:
    """A system's name as it may be searched for: without a direction behind a dash, abbreviations written out, an acronym of up to five letters in a name of up to three words replaced by what its ending says of the county."""
    clean = F.trim(F.regexp_replace(name, r"(?i)\s*[-–]\s*(EAST|WEST|NORTH|SOUTH|CENTRAL|MAIN|PRIMARY)\s*$", ""))

    def of(c: Column) -> Column:
        long = c
        for pattern, words in ABBREVIATIONS:
            long = F.regexp_replace(long, pattern, words)
        first = F.regexp_extract(F.split(c, "-")[0], r"^\s*(\S+)", 1)
        ends = lambda *x: F.lit(False) if not x else first.endswith(x[0]) | ends(*x[1:])
        short = (F.length(first) <= 5) & (F.upper(first) == first) & first.rlike("[A-Z]") & (F.length(county) > 0) & (F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")) <= 3)
        of_county = F.when(ends("SA", "CA"), F.concat(county, F.lit(" County Service Authority"))).when(ends("SD", "WD"), F.concat(county, F.lit(" Water District"))).otherwise(F.concat(county, F.lit(" County Water")))
        return F.when(F.coalesce(short, F.lit(False)), of_county).otherwise(long)

    return let(clean, of)


def city_of(name: Column) -> Column:
    """The place of "CITY OF x" and "x CITY OF" (also town, village) in title case, in the second form with Fort, Mount and Saint written out; else null."""
    before, after = F.regexp_extract(name, r"(?i)^(?:CITY|TOWN|VILLAGE)\s+OF\s+(.+?)(?:\s*[-,]|$)", 1), F.regexp_extract(name, r"(?i)^(.+?)\s+(?:CITY|TOWN|VILLAGE)\s+OF\s*$", 1)
    title = lambda x: F.initcap(F.trim(x))
    long = title(after)
    for short, word in (("Ft", "Fort"), ("Mt", "Mount"), ("St", "Saint")):
        long = F.regexp_replace(long, rf"\b{short}\b", word)
    return F.when(before != "", title(before)).when(after != "", long)


def queries_of(name: Column, state: Column, county: Column, owner: Column) -> Column:
    """Four search texts of a system: by its full name, by its place, by its company, and by its owner's kind (P: private)."""
    full = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv]), F.upper(state)), state)
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    county = F.nullif(county, F.lit(""))

    def of(best: Column) -> Column:
        area = F.when(F.contains(name, F.lit(" - ")), F.trim(F.regexp_extract(name, r"(?s)^.*? - (.*)$", 1)))
        area = F.nullif(area, F.lit(""))
        whole = F.when(area.isNotNull(), name).otherwise(best)
        where = F.coalesce(area, city_of(name), text(county, " County"))
        last = F.when(owner == "P", text('"', whole, '" tariff rate schedule ', full, " filetype:pdf")).when(area.isNotNull(), text(best, ' "', area, '" water rates ', full)).when(county.isNotNull(), text(county, " county ", full, " water rates")).otherwise(text(best, " water department rates ", full))
        return F.array_compact(F.array(text('"', whole, '" water rates ', full), text(where, " ", full, " water rate schedule"), text(best, " water utility rates fees ", full), last))

    return let(expand(name, county), of)


def candidate_urls(domain: Column, suffixes: list[str]) -> Column:
    """The domain with each path."""
    return F.transform(F.array(*[F.lit(s) for s in suffixes]), lambda s: F.concat(F.lit("https://"), domain, s))


#: The six categories; texts that say that none was found, whole and within; texts of other services.
CATEGORIES = ["flat", "uniform", "increasing_block", "decreasing_block", "budget_based", "seasonal"]
FAILED = ["failed", "unknown", "unable_to_determine", "unable to determine", "insufficient_data", "not_applicable", "not_available", "unavailable", "n/a", "not found", "failed to parse", "failed_to_determine", "uncertain"]
FAILED_WITHIN = ["unable to determine", "failed to determine", "multiple utilities", "not water", "no residential"]
OTHER_SERVICE = ["sewer", "stormwater_fee_not_water_rate", "n/a - stormwater rates only", "this is a sewer utility, not a water utility", "wholesale", "wholesale_supply", "surcharge", "tap_fees_only"]


def normal_category(text: Column, table: dict[str, str], most: int = 30) -> Column:
    """One of the six categories: the text itself, else by ``table`` (lower-case variants), also by its first ``most`` characters; null for signs of failure, other services and what the table lacks."""
    found = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])

    def of(t: Column) -> Column:
        return F.when(t.isin(CATEGORIES), t).when(t.isin(FAILED + OTHER_SERVICE) | has_any(t, FAILED_WITHIN), None).otherwise(F.coalesce(F.try_element_at(found, t), F.when(F.length(t) > most, F.try_element_at(found, F.left(t, F.lit(most))))))

    return F.when(F.length(text) > 0, let(F.lower(F.trim(text)), of))


def money(value: Column) -> Column:
    return F.when(value.isNull(), "-").otherwise(F.concat(F.lit("$"), F.format_number(value, 2)))


def compact(value: Column) -> Column:
    """Thousands as K and millions as M with one decimal."""
    return F.when(value >= 1e6, F.concat(F.format_string("%.1f", F.bround(value / 1e6, 1)), F.lit("M"))).when(value >= 1e3, F.concat(F.format_string("%.1f", F.bround(value / 1e3, 1)), F.lit("K"))).otherwise(F.format_string("%.0f", F.bround(value.cast("double"), 0)))


def percent(value: Column) -> Column:
    return F.concat(F.format_string("%.1f", F.bround(value.cast("double"), 1)), F.lit("%"))


def ramp(value: Column, stops: list[tuple[float, tuple[int, int, int]]], missing: str = "#cccccc") -> Column:
    """A colour between the stops around a value, as #rrggbb; a null value is grey."""
    colour = lambda rgb: F.format_string("#%02x%02x%02x", *[c.cast("int") for c in rgb])
    out = colour([F.lit(c) for c in stops[-1][1]])
    for (a, low), (b, high) in list(zip(stops, stops[1:]))[::-1]:
        out = F.when(value < b, colour([F.round(x + (y - x) * (value - a) / (b - a)) for x, y in zip(low, high)])).otherwise(out)
    return F.when(value.isNull(), missing).when(value <= stops[0][0], colour([F.lit(c) for c in stops[0][1]])).otherwise(out)
