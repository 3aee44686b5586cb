"""Scores of links, search results and URLs by published tables, and fingerprints of schedules in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import fixed
from .sections import let
from .text import between, count_of, has_any, host, points, slug

#: Words of the older score, domains that it marks down, terms of a URL.
OLDER_WORDS = ["water rate", "water rates", "water billing", "rate schedule", "rate structure", "water charges", "water pricing", "water tariff", "water fee", "monthly bill", "service charge", "volumetric rate", "ccf", "per gallon", "water cost"]
OLDER_BAD = ["wikipedia.org", "facebook.com", "twitter.com", "youtube.com", "yelp.com", "bbb.org", "linkedin.com", "indeed.com"]
OLDER_TERMS = ["rate", "billing", "water-rate", "tariff", "fee-schedule"]
#: Patterns of link texts, three points, one point and two off for each.
STRONG = [r"\bwater.*rate", r"\brate.*schedule", r"\bfee.*schedule", r"\butility.*rate", r"\bbilling.*calculat", r"\btariff", r"\bwater.*fee", r"\brate.*charge", r"\bsewer.*rate", r"\bwater.*sewer.*fee", r"\bamending.*water.*fee", r"\bamending.*rate"]
MODERATE = [r"\bwater\b", r"\brate\b", r"\butility.*billing", r"\bfee\b", r"\bresidential.*charge", r"\bservice.*charge", r"\bconsumption", r"\bccf\b", r"\bmetered", r"\bfy\s*20\d{2}"]
NEGATIVE = [
    r"\bminutes\b", r"\bagenda\b", r"\baudit\b", r"\bwater\s*quality", r"\bccr\b", r"\bannual.*report\b", r"\bstormwater.*management", r"\bflood", r"\bordinance\b(?!.*rate)(?!.*fee)(?!.*charge)", r"\bjob.*posting", r"\bemployment", r"\bfire\b", r"\bpolice\b", r"\bpark\b",
    r"\brecreation\b", r"\belection\b", r"\bzoning\b", r"\bcomprehensive.*plan", r"\blihwap", r"\bspanish\b", r"\binfographic\b", r"\bsafety\b(?!.*rate)", r"\btax.*rate", r"\bproperty.*tax", r"\bvision\b", r"\baflac\b", r"\binsurance\b", r"\b401k\b", r"\bbudget\b(?!.*rate)",
    r"\bbuilding.*permit", r"\bconstruction.*permit", r"\bplanning.*service", r"\bcommercial.*permit", r"\belectric\b(?!.*water)", r"\bgas\b(?!.*water)", r"\bparking\b", r"\bgarage\b",
]
#: Words of links on a first page by points each, and parts of its paths.
FIRST_WORDS = {
    25: ["water", "utility", "utilities", "public works", "public utilities", "sewer", "wastewater", "stormwater", "drinking water"],
    10: ["departments", "department", "divisions", "division", "services", "resident", "residents", "customer", "infrastructure", "operations", "public services", "environmental", "environment", "resources", "community", "government", "about", "our services"],
    20: ["rate", "fee", "billing", "tariff", "charges", "schedule of", "pay bill", "pay my bill", "account", "payment"],
    -20: [
        "police", "fire", "court", "courts", "clerk", "election", "elections", "voter", "voting", "parks", "recreation", "library", "museum", "planning", "zoning", "building permits", "human resources", "hr", "careers", "jobs", "employment", "job openings", "animal", "animal control",
        "shelter", "tax", "taxes", "assessor", "property tax", "sheriff", "jail", "corrections", "health department", "social services", "school", "schools", "education", "transit", "transportation", "bus", "cemetery", "golf", "pool", "news", "press", "press release", "blog", "calendar",
        "events", "meeting", "agenda", "minutes", "video", "photo", "gallery", "sitemap", "accessibility", "privacy", "login", "sign in", "register", "facebook", "twitter", "instagram", "youtube", "linkedin", "mailto:",
    ],
}
FIRST_PATHS = ["/water", "/utility", "/utilities", "/public-works", "/departments", "/divisions", "/services", "/residents", "/customer", "/public-utilities", "/infrastructure", "/environmental", "/dpw", "/pw", "/dpu", "/dwu"]
#: Words of links on deeper pages, before and after a PDF is judged, and link texts that say nothing.
DEEP_WORDS = {
    20: [
        "rate", "rates", "fee", "fees", "tariff", "tariffs", "schedule", "billing", "charges", "pricing", "cost of water", "water cost", "how much", "what does water cost", "rate schedule", "fee schedule", "rate structure", "current rates", "rate table", "schedule of rates", "rates effective",
        "residential rates", "commercial rates", "water charges", "sewer charges", "monthly charge", "service charge", "base charge", "usage charge", "volumetric", "tiered", "tier",
    ],
    25: ["tariff", "current rates", "rate table", "schedule of rates", "fee schedule", "rates effective", "water rate schedule", "sewer rate schedule", "rate ordinance", "rate resolution"],
}
DEEP_MORE = {
    5: ["water", "utility", "utilities", "service", "customer", "residential", "commercial", "account", "billing", "payment", "consumption", "usage", "meter", "connection", "hookup", "tap"],
    15: ["details", "more information", "view rates", "see rates", "rate information", "learn about rates", "rate details", "full schedule"],
    -15: [
        "meeting", "agenda", "minutes", "news", "press", "press release", "blog", "announcement", "job", "career", "bid", "rfp", "procurement", "contact", "contact us", "staff directory", "ccr", "water quality report", "consumer confidence", "petition", "case", "hearing", "testimony", "docket",
        "proceeding", "filing", "annual report", "rate case", "conservation", "rebate", "incentive", "assistance", "hardship", "low income", "start service", "stop service", "transfer", "outage", "emergency", "boil water", "construction", "project", "capital improvement", "faq",
        "frequently asked",
    ],
}
DEEP_PDF = ["tariff", "rate", "schedule", "fee", "charge"]
EMPTY_LINKS = ["here", "click here", "learn more", "read more", "view more", "download", "see more", "details", "more", "continue", "next"]
#: Amounts that say nothing, and words of phrases that say nothing.
COMMON_AMOUNTS = ["5.00", "10.00", "15.00", "20.00", "25.00", "50.00", "100.00", "1.00", "2.00", "3.00", "5", "10", "15", "20", "25", "50", "100"]
COMMON_WORDS = [
    "water", "rate", "rates", "service", "monthly", "residential", "customer", "customers", "tier", "tiers", "structure", "fee", "charge", "charges", "fixed", "volumetric", "billing", "meter", "5/8", "3/4", "inch", "gallons", "gallon", "ccf", "kgal", "per", "the", "for", "with", "and", "from",
    "first", "second", "third", "minimum", "basic",
]


def older_score(title: Column, snippet: Column, url: Column) -> Column:
    """2 a keyword of title and snippet, 3 for .gov or 1.5 for .org, -10 a bad domain, 2 a term of the URL, 1.5 for a PDF."""
    text, h, u = F.lower(F.concat_ws(" ", title, snippet)), host(url), F.lower(url)
    return (2.0 * count_of(text, OLDER_WORDS) + F.when(h.endswith(".gov"), 3.0).when(h.endswith(".org"), 1.5).otherwise(0.0) - 10.0 * count_of(h, OLDER_BAD) + 2.0 * count_of(u, OLDER_TERMS) + F.when(u.endswith(".pdf"), 1.5).otherwise(0.0)).cast("double")


def link_score(title: Column, url: Column) -> Column:
    """3 a strong pattern of the link's text, 1 a moderate one, -2 a negative one; 1 for a document centre, 0.5 for a PDF."""
    hits = lambda t, patterns: sum((F.when(t.rlike(p), 1).otherwise(0) for p in patterns), F.lit(0))
    u = F.lower(url)
    return let(F.lower(title), lambda t: 3.0 * hits(t, STRONG) + hits(t, MODERATE) - 2.0 * hits(t, NEGATIVE) + points((u.contains("documentcenter"), 1.0), (u.contains(".pdf") | t.contains("(pdf)"), 0.5)))


def crawl_score(url: Column, label: Column, level: Column) -> Column:
    """Points, 0 at least, of a link by the level of its page: on a first page what leads to the utility, deeper what leads to rates."""
    weigh = lambda t, table: sum((p * count_of(t, words) for p, words in table.items()), F.lit(0))

    def of(t: Column) -> Column:
        href = F.lower(url)
        first = weigh(t, FIRST_WORDS) + 15 * count_of(href, FIRST_PATHS)
        pdf = lambda s: s + F.when(href.endswith(".pdf"), F.when(has_any(t, DEEP_PDF), 30).when(s > 0, 15).otherwise(0)).otherwise(0)
        deep = let(weigh(t, DEEP_WORDS), pdf) + weigh(t, DEEP_MORE) + F.when(F.trim(F.lower(label)).isin(EMPTY_LINKS), -15).otherwise(0)
        return F.greatest(F.when(level == 1, first).otherwise(deep), F.lit(0)).cast("int")

    return let(F.concat(F.lower(url), F.lit(" "), label), of)


def local_score(score: Column, url: Column, place: Column, contaminated: Column) -> Column:
    """A URL's score with 20 if the host has the place's name, less 15 if many keys have the URL; 0 to 100."""
    name = slug(place)
    bare = slug(F.replace(host(url), F.lit("www."), F.lit("")))
    return between(score + points(((F.length(name) > 3) & bare.contains(name), 20), (contaminated, -15)), 0, 100).cast("int")


def amount_tokens(bills: Column, charges: Column, rates: Column) -> Column:
    """The forms in which a schedule's amounts may stand in a text, sorted: bills and charges over 0.5, rates over 0.05; common amounts left out."""
    over = lambda a, least: F.filter(F.coalesce(a, F.array().cast("array<double>")), lambda v: v > least)
    values = F.array_distinct(F.concat(over(bills, 0.5), over(charges, 0.5), over(rates, 0.05)))

    def forms(v: Column) -> Column:
        plain = fixed(v)
        return F.array_compact(
            F.array(plain, F.when(v >= 1000, F.regexp_replace(plain, r"(?<=\d)(?=(\d{3})+\.)", ",")), F.when(plain.endswith("0"), F.regexp_replace(plain, r"\.?0+$", "")), F.when((v == F.floor(v)) & (v >= 10), v.cast("decimal(20,0)").cast("string")))
        )

    return F.array_sort(F.array_except(F.array_distinct(F.flatten(F.transform(values, forms))), F.array(*[F.lit(x) for x in COMMON_AMOUNTS])))


def phrase_tokens(notes: Column) -> Column:
    """Names in the first 500 characters of notes, the longest first: runs of capitalised words (not all of them common), hyphenated names, places with a state and without."""
    every = lambda t, p: F.regexp_extract_all(t, F.lit(p), F.lit(0))

    def of(t: Column) -> Column:
        common = F.array(*[F.lit(w) for w in COMMON_WORDS])
        runs = F.filter(every(t, r"\b[A-Z][a-zA-Z]+(?:[\s\-][A-Z][a-zA-Z]+){1,4}\b"), lambda p: (F.length(p) >= 6) & ~F.forall(F.split(p, r"\s+"), lambda w: F.array_contains(common, F.lower(w))))
        places = every(t, r"\b[A-Z][a-zA-Z]+(?:\s[A-Z][a-zA-Z]+)?,\s[A-Z]{2}\b")
        alone = F.filter(F.transform(places, lambda p: F.trim(F.substring_index(p, ",", 1))), lambda p: F.length(p) >= 4)
        found = F.array_distinct(F.concat(runs, every(t, r"\b[A-Z][a-z]+-[A-Z][a-z]+(?:-[A-Z][a-z]+)*\b"), places, alone))
        return F.transform(F.array_sort(F.transform(found, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))), lambda x: x["p"])

    return let(F.left(F.coalesce(notes, F.lit("")), F.lit(500)), of)


def fingerprint(text: Column, amounts: Column, phrases: Column) -> Column:
    """struct<score,amounts,phrases>: how many of a schedule's amounts and phrases stand in a text; a phrase counts as five amounts."""
    return let(F.coalesce(text, F.lit("")), lambda t: let(F.lower(t), lambda low: let(F.struct(F.size(F.filter(amounts, lambda a: t.contains(a))).alias("a"), F.size(F.filter(phrases, lambda p: t.contains(p) | low.contains(F.lower(p)))).alias("p")), lambda n: F.struct((n["a"] + 5 * n["p"]).alias("score"), n["a"].alias("amounts"), n["p"].alias("phrases")))))
