"""Queues, funnels, triage and coverage rollups over registries and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import best_by, top_by


def first_match(text: Column, rules: list[tuple[list[str], str]], otherwise: Column | str | None = None) -> Column:
    """The label of the first rule of which a keyword stands in the text."""
    out = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for words, label in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        out = F.when(hit, label).otherwise(out)
    return out


#: Keywords of the failure modes of a parse, in their order.
AUTH = ["login", "sign in", "sign-in", "subscribe", "access denied", "authentication", "log in"]
SCRIPT = ["javascript", "loading", "dynamic content", "client-side"]
COMBINED = ["combined", "cannot separate", "water and sewer", "water & sewer", "includes sewer", "bundled", "water/sewer", "separate water"]
LINKED = ["link", "download", "navigate", "click", "redirect", "another page", "separate document", "pdf available"]
SCANNED = ["garbled", "unreadable", "scanned", "image-based", "ocr"]


def failure_mode(notes: Column, total: Column, with_text: Column, result: Column, confidence: Column, kind: Column, longest: Column) -> Column:
    """Why a key has no rate yet: the first of a cascade of reasons."""
    note, res, unparsed = F.lower(F.coalesce(notes, F.lit(""))), F.lower(F.coalesce(result, F.lit(""))), ["", "none", "nan"]
    has = lambda words: first_match(note, [(words, "x")]).isNotNull()
    total, with_text = F.coalesce(total, F.lit(0)), F.coalesce(with_text, F.lit(0))
    kind = F.lower(F.coalesce(kind, F.lit("")))
    return (
        F.when(total == 0, "scrape_failed")
        .when((with_text > 0) & res.isin(unparsed), "never_parsed")
        .when(has(AUTH), "auth_paywall")
        .when(has(SCRIPT), "js_wall")
        .when(with_text == 0, "scrape_failed")
        .when((longest > 0) & (longest < 200) & (kind == "html"), "js_wall")
        .when(has(COMBINED), "water_sewer_combined")
        .when(has(LINKED), "rates_behind_link")
        .when((F.lower(confidence) == "low") & ~res.isin("failed", ""), "partial_extraction")
        .when(kind.contains("pdf") & (has(SCANNED) | (res == "failed")), "pdf_extraction_failed")
        .when(res.isin("failed", "skipped"), "wrong_url_all_ranks")
        .when((with_text > 0) & ~res.isin("failed", "skipped", *unparsed), "partial_extraction")
        .otherwise("other")
    )


def with_shares(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, total, pct_count, pct_total): a summary with shares of the whole; the whole is one row."""
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    whole = out.agg(F.sum("n").alias("__n"), F.sum("total").alias("__t"))
    return out.join(F.broadcast(whole)).select(by, "n", "total", F.round(100 * F.col("n") / F.col("__n"), 1).alias("pct_count"), F.round(100 * F.col("total") / F.col("__t"), 1).alias("pct_total"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str], value: Column | None = None) -> DataFrame:
    """Counts (or sums of ``value``) by row and column with margins called All; absent pairs are 0."""
    made = df.cube(row, column).agg(F.grouping(row).alias("__r"), F.grouping(column).alias("__c"), (F.sum(value) if value is not None else F.count(F.lit(1))).alias("n"))
    made = made.withColumn("__row", F.when(F.col("__r") == 1, "All").otherwise(F.col(row))).withColumn("__col", F.when(F.col("__c") == 1, "All").otherwise(F.col(column)))
    return made.groupBy(F.col("__row").alias(row)).pivot("__col", [*values, "All"]).agg(F.first("n")).fillna(0)


def retry_state(status: Column, http: Column, retries: Column, at: Column) -> tuple[Column, Column]:
    """(status, retry_after) after a failed fetch: 404 dead; 403 waits 2^n days, 30 at most, and is dead after five; 5xx six hours; else a day."""
    n = retries + 1
    dead = (http == 404) | ((http == 403) & (n > 5))
    wait = F.when(http == 403, F.least(F.pow(F.lit(2), n), F.lit(30)) * 86400).when(http >= 500, F.lit(6 * 3600)).otherwise(F.lit(86400))
    after = F.timestamp_seconds(F.unix_timestamp(at) + wait.cast("long"))
    return F.when(F.coalesce(dead, F.lit(False)), "dead").otherwise("pending_retry"), F.when(~F.coalesce(dead, F.lit(False)), after)


def best_candidates(df: DataFrame, key: str, score: Column, *, least: float = 30, strategy: str = "shotgun", then: list[Column] | None = None) -> DataFrame:
    """Scored candidates at ``least`` or more, ranked by key: all of them (shotgun), or the best one (cascade, rank1)."""
    scored = df.withColumn("score", score).filter(F.col("score") >= least)
    order = [F.desc("score"), *(then or [])]
    if strategy == "shotgun":
        return top_by(scored, [key], order, 1 << 30)
    return best_by(scored, [key], [-F.col("score"), *(then or [])]).withColumn("rank", F.lit(1))


#: Least length of a text, portals of one state.
TEXT_LEAST, PORTALS, PORTAL_STATE = 200, ["www.ny.gov", "www.nyc.gov"], "NY"


def gap_triage(gaps: DataFrame, registry: DataFrame, blacklist: list[str], length: Column | None = None) -> DataFrame:
    """(pwsid, class, reason, id, url) of keys without an estimate (pwsid, state_code): what can still be parsed of them.

    Of a key's URLs with a text of TEXT_LEAST or more that aren't dead: submittable with the longest one that was never
    parsed and whose host isn't on the blacklist; else blacklisted_only if all hosts are; else, in PORTAL_STATE,
    ny_portal_only if all are portals; else exhausted, also without any URL. An unknown length goes before the longest, equal ones by id.
    """
    name = F.regexp_extract(F.lower("url"), r"^[a-z]+://(?:[^/@]*@)?([^/:?#]*)", 1)
    size = F.length("scraped_text") if length is None else length
    r = registry.filter((size >= TEXT_LEAST) & (F.col("status") != "dead")).select(F.col("pwsid").alias("__key"), "id", "url", "last_content_length", "last_parse_result", name.isin(blacklist).alias("__bad"), name.isin(PORTALS).alias("__portal"))
    good = F.col("last_parse_result").isNull() & ~F.col("__bad")
    of = r.groupBy("__key").agg(F.min_by(F.when(good, F.struct("id", "url")), F.when(good, F.struct(F.col("last_content_length").isNotNull().alias("known"), (-F.col("last_content_length")).alias("n"), "id"))).alias("__u"), F.bool_and("__bad").alias("__all"), F.bool_and("__portal").alias("__portals"))
    j = gaps.join(of, F.col("pwsid") == F.col("__key"), "left")
    portal = (F.col("state_code") == PORTAL_STATE) & F.col("__portals")
    kind = F.when(F.col("__key").isNull(), "exhausted").when(F.col("__u").isNotNull(), "submittable").when(F.col("__all"), "blacklisted_only").when(F.coalesce(portal, F.lit(False)), "ny_portal_only").otherwise("exhausted")
    reason = F.when(F.col("__key").isNull(), "no_text_available").when(kind == "blacklisted_only", "all_urls_blacklisted").when(kind == "ny_portal_only", "ny_portal_only").when(kind == "exhausted", "all_ranks_tried")
    return j.select("pwsid", kind.alias("class"), reason.alias("reason"), "__u.id", "__u.url")


def funnel(df: DataFrame, key: str, url: str, score: Column, *, threshold: float = 30.0, near: float = 15.0, k: int = 5) -> DataFrame:
    """Distinct (key, url) with score, class (kept, near_miss, below) and, of those kept, the rank from 1; later ranks than k are dropped."""
    rows = df.groupBy(key, url).agg(F.max(score).alias("score"))
    rows = rows.withColumn("class", F.when(F.col("score") > threshold, "kept").when(F.col("score") >= near, "near_miss").otherwise("below"))
    kept = top_by(rows.filter("class = 'kept'"), [key], [F.desc("score"), F.asc(url)], k)
    return kept.unionByName(rows.filter("class <> 'kept'").withColumn("rank", F.lit(None).cast("int")))


def task_queue(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Union of limited queues (each ordered already) by priority; ``parts`` are (frame, limit)."""
    out = None
    for frame, limit in parts:
        out = frame.limit(limit) if out is None else out.unionByName(frame.limit(limit))
    return out.orderBy("priority", "id")


def missing_then_retry(gap: DataFrame, retry: DataFrame, key: str) -> DataFrame:
    """Gap keys, then retry keys that are not in the gap, each with its reason."""
    return gap.withColumn("reason", F.lit("gap")).unionByName(retry.join(gap.select(key).distinct(), key, "left_anti").withColumn("reason", F.lit("retry")))


def coverage_rollup(df: DataFrame, by: list[Column], covered: Column, population: Column) -> DataFrame:
    """Counts and population of all and of covered keys by group, with percentages."""
    pop = lambda c: F.coalesce(F.sum(F.when(c, population)), F.lit(0))
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(covered).alias("n_covered"), pop(F.lit(True)).alias("pop"), pop(covered).alias("pop_covered"))
    return out.withColumn("pct", F.round(100 * F.col("n_covered") / F.nullif(F.col("n"), F.lit(0)), 1)).withColumn("pop_pct", F.round(100 * F.col("pop_covered") / F.nullif(F.col("pop"), F.lit(0)), 1))


def violation_rollup(df: DataFrame, *, key: str = "key", as_of_year: int, years: int = 5) -> DataFrame:
    """Per key with a violation since ``years`` ago: their count, the health-based ones, and the latest date of all years."""
    recent = F.year("begun") >= as_of_year - years
    out = df.groupBy(key).agg(F.count_if(recent).alias("violations"), F.count_if(recent & (F.col("health") == "Y")).alias("health"), F.max("begun").alias("latest"))
    return out.filter("violations > 0")


def joined(left: DataFrame, right: DataFrame, on: str, *, only_matched: bool) -> DataFrame:
    """``left`` with the rows of ``right``: an inner join if only matched rows are asked for, else a left one."""
    return left.join(right, on, "inner" if only_matched else "left")


#: Share of a state's keys with rates below which it is a gap, in percent; days between searches; people from which a system is searched for; retries of one queue.
GAP_PERCENT, SEARCH_DAYS, SEARCHED_FROM, RETRIES = 20, 30, 3000, 20


def coverage_gaps(coverage: DataFrame, as_of: Column, *, state: str | None = None) -> DataFrame:
    """Keys worth a search, with priority and place: no rates, not attempted or with an address, a tier, not searched for SEARCH_DAYS, large or with an address, and in a gap state (any state if one is asked for) or with an address.

    ``coverage``: pwsid, state_code, has_rate_data, scrape_status, priority_tier, search_attempted_at, population_served.
    """
    found = F.col("scrape_status") == "url_discovered"
    gaps = coverage.groupBy(F.col("state_code").alias("__s")).agg((F.round(100 * F.count_if("has_rate_data") / F.count(F.lit(1)), 1) < GAP_PERCENT).alias("__gap"))
    rows = coverage.filter(~F.col("has_rate_data") & F.col("scrape_status").isin("not_attempted", "url_discovered") & F.col("priority_tier").isNotNull())
    rows = rows.filter(F.col("search_attempted_at").isNull() | (F.col("search_attempted_at") < as_of - F.make_interval(days=F.lit(SEARCH_DAYS)))).filter((F.col("population_served") > SEARCHED_FROM) | found)
    if state is None:
        rows = rows.join(gaps, F.col("state_code") == F.col("__s"), "left").filter(F.coalesce("__gap", F.lit(False)) | found).drop("__s", "__gap")
    else:
        rows = rows.filter(F.col("state_code") == state.upper())
    return rows.select("pwsid", (F.col("priority_tier") * 10).alias("priority"), F.struct((~found).alias("a"), F.col("priority_tier").alias("b"), (-F.coalesce("population_served", F.lit(-1))).alias("c"), F.col("pwsid").alias("d")).alias("place"))


def agent_queue(catalog: DataFrame, coverage: DataFrame, registry: DataFrame, as_of: Column, *, batch: int, days: int, changes: int, state: str | None = None) -> DataFrame:
    """(task, priority, key) of the four queues: sources that are due, gaps (``batch``), failures that may be retried (RETRIES), addresses not fetched for ``days`` (``changes``).

    ``catalog``: source_key, next_check_date; ``registry``: id, status, retry_after, retry_count, last_fetch_at. The first
    queue goes before the gaps of tier 0, each queue is in its own order; equal places go by id.
    """
    task = lambda df, name, priority, key: df.select(F.lit(name).alias("task"), priority.cast("int").alias("priority"), F.col(key).cast("string").alias("key"))
    due = catalog.filter(F.col("next_check_date") <= as_of.cast("date"))
    gaps = coverage_gaps(coverage, as_of, state=state).orderBy("place").limit(batch)
    retries = registry.filter((F.col("status") == "pending_retry") & (F.col("retry_after") <= as_of)).orderBy("retry_count", "id").limit(RETRIES)
    stale = registry.filter((F.col("status") == "active") & (F.col("last_fetch_at") < as_of - F.make_interval(days=F.lit(days)))).orderBy("last_fetch_at", "id").limit(changes)
    return task(due, "check_bulk_source", F.lit(0), "source_key").unionByName(task(gaps, "discover_and_scrape", F.col("priority"), "pwsid")).unionByName(task(retries, "retry_scrape", F.lit(30), "id")).unionByName(task(stale, "change_detection", F.lit(50), "id"))


def best_texts(candidates: DataFrame, wrong: list[str]) -> DataFrame:
    """One of ``candidates`` (id, pwsid, url, last_parse_result, content_len) a key: none of another entity's (``wrong``: parts of URLs), the never parsed ones first, then the longest, then by id."""
    rows = candidates
    for part in wrong:
        rows = rows.filter(~F.lower("url").contains(part))
    return best_by(rows, ["pwsid"], [F.col("last_parse_result").isNotNull(), -F.coalesce("content_len", F.lit(0)), F.col("id")])
