"""Selection: source priorities, comparable bills, the best estimate of a key, one row per key."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import exact_round


@dataclass(frozen=True)
class Priorities:
    """What ranks sources: exact names, then prefixes in order, then a fallback; anchors and tolerance by state."""

    exact: dict[str, int]
    prefixes: tuple[tuple[str, int], ...] = ()
    fallback: int = 5
    tiers: dict[str, str] = field(default_factory=dict)
    prefix_tiers: tuple[tuple[str, str], ...] = ()
    fallback_tier: str = "free"
    anchors: dict[str, tuple[tuple[str, ...], float]] = field(default_factory=dict)


#: The published configuration.
PUBLISHED = Priorities(
    exact={
        "scraped_llm": 1, "swrcb_ear_2022": 3, "swrcb_ear_2021": 4, "swrcb_ear_2020": 6, "efc_nc_2025": 3, "efc_ar_2020": 5, "efc_ia_2023": 5, "efc_wi_2016": 5, "efc_ga_2019": 5, "efc_oh_2019": 5, "efc_ms_2022": 5, "efc_az_2014": 5, "efc_al_2018": 5, "efc_fl_2020": 5, "efc_ma_2017": 5,
        "efc_il_2018": 5, "efc_vt_2021": 5, "efc_nh_2016": 5, "efc_ct_2018": 5, "efc_me_2018": 5, "efc_mo_2015": 5, "efc_hi_2020": 5, "efc_de_2018": 5, "efc_sc_2014": 5, "owrs": 5, "wv_psc_2026": 5, "nm_nmed_rate_survey_2025": 5, "in_iurc_water_billing_2024": 5, "ky_psc_water_tariffs_2025": 5,
        "tx_tml_2023": 8, "duke_nieps_10state": 8,
    },
    prefixes=(("efc_", 3), ("swrcb_", 3)),
    fallback=5,
    tiers={"scraped_llm": "premium", "duke_nieps_10state": "reference"},
    prefix_tiers=(("efc_", "free"), ("swrcb_", "free")),
    fallback_tier="free",
    anchors={"CA": (("swrcb_ear_2022", "swrcb_ear_2021"), 0.25)},
)


def resolve(source: Column, exact: dict, prefixes, fallback) -> Column:
    """Exact name, then the first prefix that fits, then the fallback: one expression, no join."""
    out = F.lit(fallback)
    for prefix, value in reversed(tuple(prefixes)):
        out = F.when(source.startswith(prefix), value).otherwise(out)
    for name, value in exact.items():
        out = F.when(source == name, value).otherwise(out)
    return out


def priority_of(source: Column, exact: dict[str, int], prefixes, fallback: int = 5) -> Column:
    return resolve(source, exact, prefixes, fallback)


def comparable_bill(b10: Column, b9: Column, b12: Column, b6: Column | None = None) -> Column:
    """The bill at 10 CCF, else between 9 and 12, else at 12, else (where given) at 6; only positive bills count."""
    good = lambda b: F.when((b > 0) & ~F.isnan(b), b)
    steps = [good(b10), exact_round(good(b9) + (good(b12) - good(b9)) / 3.0, 2), good(b12)]
    return F.coalesce(*steps, *([good(b6)] if b6 is not None else []))


def comparable_method(b10: Column, b9: Column, b12: Column) -> Column:
    return F.when(b10 > 0, "10ccf").when((b9 > 0) & (b12 > 0), "interp_10").when(b12 > 0, "12ccf")


def best_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``, which should be total. A min_by aggregate: partial before the shuffle."""
    names = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("__best"))
    return picked.select(*keys, *[F.col(f"__best.`{c}`").alias(c) for c in names])


def top_by(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key with their ranks from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


#: Columns of the chosen row that an estimate keeps.
PASSED = ("utility_name", "bill_5ccf", "fixed_charge_monthly", "rate_structure_type", "source_url")


def best_estimate(rates: DataFrame, config: Priorities = PUBLISHED) -> DataFrame:
    """One row per pwsid: the comparable bill of the source of the best priority, with anchor, confidence and notes.

    ``rates`` has id, pwsid, state_code, source, bill_6ccf, bill_9ccf, bill_10ccf, bill_12ccf, confidence and
    vintage_date. Equal priorities go by source, then the later vintage, then id. One aggregate, one shuffle; keys
    without a comparable bill keep a row of confidence ``none``. Of the columns PASSED those that ``rates`` has come along
    with the chosen row, its own confidence as parse_confidence.
    """
    passed = [c for c in PASSED if c in rates.columns]
    bill = comparable_bill(F.col("bill_10ccf"), F.col("bill_9ccf"), F.col("bill_12ccf"), F.col("bill_6ccf"))
    low = (F.col("source") == "scraped_llm") & (F.col("confidence") == "low")
    base = resolve(F.col("source"), config.exact, config.prefixes, config.fallback)
    rank, tolerance = F.lit(None).cast("int"), F.lit(0.25)
    for state, (sources, most) in config.anchors.items():
        for k, source in enumerate(sources):
            rank = F.when((F.col("state_code") == state) & (F.col("source") == source), k).otherwise(rank)
        tolerance = F.when(F.col("state_code") == state, most).otherwise(tolerance)
    rows = rates.withColumn("comp", bill).withColumn("priority", F.when(low, F.greatest(base, F.lit(6))).otherwise(base)).withColumn("anchor_rank", F.when(F.col("comp").isNotNull(), rank))
    order = F.struct("priority", "source", F.coalesce(F.datediff(F.lit("9999-12-31"), "vintage_date"), F.lit(1 << 30)), "id")
    best = F.struct("source", "comp", "priority", "confidence", "vintage_date", "bill_10ccf", "bill_6ccf", "bill_12ccf", *passed)
    out = rows.groupBy("pwsid").agg(
        F.min_by("state_code", "id").alias("state_code"),
        F.min_by(best, F.when(F.col("comp").isNotNull(), order)).alias("best"),
        F.min_by(F.struct("source", "comp"), F.when(F.col("anchor_rank").isNotNull(), F.struct("anchor_rank", "id"))).alias("anchor"),
        F.size(F.collect_set("source")).alias("n_sources"),
    )
    diff = F.abs(F.col("best.comp") - F.col("anchor.comp")) / F.col("anchor.comp")
    share = F.concat(F.lit(" ("), F.bround(diff * 100, 0).cast("int").cast("string"), F.lit("% diff)"))
    notes = (
        F.when(F.col("best").isNull(), "no comparable bill from any source")
        .when(F.col("best.source") != "scraped_llm", "")
        .when(F.col("best.confidence") == "low", "low_confidence")
        .when(F.col("anchor").isNull(), "no_anchor_available")
        .when(diff <= tolerance, F.concat(F.lit("anchor_agrees"), share))
        .otherwise(F.concat(F.lit("anchor_diverges_qa_flag"), share))
    )
    source = F.col("best.source")
    confidence = (
        F.when(F.col("best").isNull(), "none")
        .when((F.col("best.priority") == 0) | source.startswith("swrcb_ear") | source.startswith("efc_"), "high")
        .when(source == "owrs", "medium")
        .when(F.col("best.confidence") == "low", "low")
        .otherwise("medium")
    )
    return out.select(
        "pwsid", "state_code", source.alias("selected_source"), exact_round(F.col("best.comp"), 2).alias("bill_estimate_10ccf"), F.col("best.bill_10ccf").alias("bill_10ccf"), F.col("best.bill_6ccf").alias("bill_6ccf"), F.col("best.bill_12ccf").alias("bill_12ccf"),
        F.col("best.vintage_date").alias("vintage_date"), "n_sources", F.col("anchor.source").alias("anchor_source"), F.col("anchor.comp").alias("anchor_bill"), confidence.alias("confidence"), notes.alias("selection_notes"),
        F.col("best.confidence").alias("parse_confidence"), *[F.col(f"best.{c}").alias(c) for c in passed],
    )


#: Priorities and anchors of the older selector, and the share by which a scraped bill may differ from its anchor.
OLDER_PRIORITIES = {"swrcb_ear_2022": 1, "swrcb_ear_2021": 2, "scraped_llm": 3, "owrs": 4, "swrcb_ear_2020": 5}
OLDER_ANCHORS, OLDER_TOLERANCE = ("swrcb_ear_2022", "swrcb_ear_2021"), 0.25


def older_estimate(rates: DataFrame) -> DataFrame:
    """One row per pwsid by the older selector: a scraped bill goes before all if it agrees with the government's, behind it if not; others by priority.

    ``rates`` as for best_estimate. Equal priorities go by source and id. Keys without a comparable bill keep a row of
    confidence ``none``.
    """
    rows = rates.withColumn("comp", comparable_bill(F.col("bill_10ccf"), F.col("bill_9ccf"), F.col("bill_12ccf"), F.col("bill_6ccf")))
    place = F.coalesce(*[F.when((F.col("source") == s) & F.col("comp").isNotNull(), F.lit(k)) for k, s in enumerate(OLDER_ANCHORS)])
    anchors = rows.groupBy(F.col("pwsid").alias("__key")).agg(F.min_by(F.struct("source", "comp"), F.when(place.isNotNull(), F.struct(place.alias("k"), "id"))).alias("anchor"), F.count_distinct("source").alias("n_sources"))
    rows = rows.join(anchors, F.col("pwsid") == F.col("__key"))
    diff = F.abs(F.col("comp") - F.col("anchor.comp")) / F.col("anchor.comp")
    scraped, low = F.col("source") == "scraped_llm", F.coalesce(F.col("confidence"), F.lit("medium")) == "low"
    share = F.concat(F.lit(" ("), F.bround(diff * 100, 0).cast("int").cast("string"), F.lit("% diff)"))
    priority = F.when(~scraped, resolve(F.col("source"), OLDER_PRIORITIES, (), 99)).when(low, 6).when(F.col("anchor").isNull(), 3).when(diff <= OLDER_TOLERANCE, 0).otherwise(5)
    notes = F.when(~scraped, "").when(low, "low_confidence").when(F.col("anchor").isNull(), "no_ear_anchor").when(diff <= OLDER_TOLERANCE, F.concat(F.lit("scraped_agrees_with_ear"), share)).otherwise(F.concat(F.lit("scraped_diverges_from_ear"), share))
    rows = rows.withColumn("priority", priority).withColumn("notes", notes)
    best = F.min_by(F.struct("source", "comp", "priority", "confidence", "notes", "vintage_date"), F.when(F.col("comp").isNotNull(), F.struct("priority", "source", "id")))
    out = rows.groupBy("pwsid").agg(best.alias("b"), F.first("anchor").alias("anchor"), F.first("n_sources").alias("n_sources"))
    source = F.col("b.source")
    confidence = F.when(F.col("b").isNull(), "none").when((F.col("b.priority") == 0) | source.startswith("swrcb_ear"), "high").when(source == "owrs", "medium").when(F.col("b.confidence") == "low", "low").otherwise("medium")
    return out.select(
        "pwsid", source.alias("selected_source"), F.col("b.comp").alias("bill"), F.col("b.vintage_date").alias("vintage_date"), "n_sources", F.col("anchor.source").alias("anchor_source"), F.col("anchor.comp").alias("anchor_bill"), confidence.alias("confidence"),
        F.when(F.col("b").isNull(), "no comparable bill from any source").otherwise(F.col("b.notes")).alias("selection_notes"),
    )


#: Labels of a host that say nothing of whose it is.
COMMON_LABELS = ["com", "org", "net", "gov", "us", "www"]


def best_guess(guesses: DataFrame, host) -> DataFrame:
    """(pwsid, url) of guessed addresses (id, pwsid, guessed_url, final_url, domain, confidence_tier, confidence_score): the best one where it leads.

    A guess that leads to a host which shares no telling label with it is left out, as is one without a URL. Domains of
    water come first, then the higher score, then (for the others) .gov, then id. ``host`` gives a URL's host.
    """
    final = F.coalesce(F.nullif("final_url", F.lit("")), F.col("guessed_url"))
    bare = lambda u: F.replace(host(u), F.lit("www."), F.lit(""))
    labels = lambda h: F.array_except(F.split(h, r"\."), F.array(*[F.lit(x) for x in COMMON_LABELS]))
    rows = guesses.filter("guessed_url <> ''").withColumn("__final", final).withColumn("__a", bare(F.col("guessed_url"))).withColumn("__b", bare(final))
    related = (F.col("__a") == F.col("__b")) | (F.col("__a") == "") | (F.col("__b") == "") | F.arrays_overlap(labels(F.col("__a")), labels(F.col("__b")))
    water = (F.coalesce(F.col("confidence_tier"), F.lit("")) == "name_water") | F.lower(F.coalesce("domain", F.lit(""))).contains("water")
    order = F.struct((~water).alias("w"), (-F.coalesce("confidence_score", F.lit(0))).alias("s"), (~water & ~F.col("__final").contains(".gov")).alias("g"), "id")
    return rows.filter(related).groupBy("pwsid").agg(F.min_by("__final", order).alias("url"))


def anchored_estimate(rates: DataFrame, anchor: str, candidate: str, tolerance: float = 0.25) -> DataFrame:
    """The older rule: a candidate source wins where it agrees with its key's anchor, or there is no anchor; else the anchor wins."""
    bill = comparable_bill(F.col("bill_10ccf"), F.col("bill_9ccf"), F.col("bill_12ccf"), F.col("bill_6ccf"))
    rows = rates.withColumn("comp", bill).filter("comp is not null")
    first = lambda s: F.min_by("comp", F.when(F.col("source") == s, F.col("id")))
    out = rows.groupBy("pwsid").agg(first(anchor).alias("anchor"), first(candidate).alias("candidate"))
    agrees = F.abs(F.col("candidate") - F.col("anchor")) / F.col("anchor") <= tolerance
    wins = F.col("candidate").isNotNull() & (F.col("anchor").isNull() | agrees)
    picked = F.when(wins, F.lit(candidate)).when(F.col("anchor").isNotNull(), F.lit(anchor))
    return out.select("pwsid", picked.alias("source"), F.when(wins, F.col("candidate")).otherwise(F.col("anchor")).alias("bill")).filter("source is not null")


def scrape_status(registry: DataFrame, keys: DataFrame, key: str = "pwsid") -> DataFrame:
    """``keys`` (key, scrape_status) with the status by the registry; later rules win over earlier ones.

    ``registry``: key, status, last_parse_result, last_fetch_at, last_http_status. A success gives succeeded; without
    one, a fetch with an HTTP status gives attempted_failed; a pending URL and no fetch at all give url_discovered; no
    entry gives not_attempted; entries that fit no rule leave the old status.
    """
    any_of = lambda c: F.max(F.coalesce(c, F.lit(False)))
    seen = registry.groupBy(F.col(key).alias("__key")).agg(
        any_of(F.col("last_parse_result") == "success").alias("success"), any_of(F.col("last_fetch_at").isNotNull() & F.col("last_http_status").isNotNull()).alias("answered"),
        any_of(F.col("status") == "pending").alias("pending"), any_of(F.col("last_fetch_at").isNotNull()).alias("fetched"),
    )
    status = F.when(F.col("__key").isNull(), "not_attempted").when(F.col("pending") & ~F.col("fetched"), "url_discovered").when(F.col("success"), "succeeded").when(F.col("answered"), "attempted_failed").otherwise(F.col("scrape_status"))
    return keys.join(seen, keys[key] == F.col("__key"), "left").withColumn("scrape_status", status).select(*keys.columns)


def most_complete(df: DataFrame, keys: list[str], columns: list[str], then: list[Column]) -> DataFrame:
    """One row per key: that with the most non-null ``columns``; ties by ``then``."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return best_by(df, keys, [(-filled).alias("filled"), *then])


def highest_category(categories: Column, order: list[str]) -> Column:
    """Of an array of categories the first in ``order``; null if none is in it."""
    return F.get(F.array_intersect(F.array(*[F.lit(c) for c in order]), categories), F.lit(0))


def meter_row(meters: Column, wanted: float = 0.625) -> Column:
    """Of array<struct<size,amount>> the first of about the wanted size, else the smallest."""
    near = F.filter(meters, lambda m: F.abs(m["size"] - wanted) < 0.001)
    return F.coalesce(F.get(near, F.lit(0)), F.array_min(F.filter(meters, lambda m: m["size"].isNotNull())))
