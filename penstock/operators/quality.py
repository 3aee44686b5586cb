"""Quality flags, grades and issue lists of single schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import numbers


def flag_list(*flags: tuple[Column, Column | str]) -> Column:
    """array<string>: the labels whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(when, label if isinstance(label, Column) else F.lit(label)) for when, label in flags]))


def record_flags(source: Column, limits: dict[str, Column], bill: Column, fixed: Column, vintage: Column, *, suspect_limit: float = 500.0, low: float = 2.0, high: float = 500.0, stale_year: int = 2015) -> Column:
    """Flags of a schedule with their values: the first of the tier limits (by name) that is inflated, low and high bills, odd fixed charges, stale vintage."""
    whole = lambda v: F.format_string("%.0f", F.bround(v.cast("double"), 0))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    inflated = F.coalesce(*[F.when(v > suspect_limit, text(name, "=", whole(v))) for name, v in limits.items()])
    return flag_list(
        (source.contains("ear") & inflated.isNotNull(), text("ear_tier_limit_inflated (", inflated, ")")),
        (bill < low, text("bill_suspiciously_low ($", numbers.fixed(bill), ")")),
        (bill > high, text("bill_suspiciously_high ($", whole(bill), ")")),
        (fixed > 200, text("fixed_charge_high ($", whole(fixed), ")")),
        (fixed < 0, "fixed_charge_negative"),
        (F.year(vintage) < stale_year, text("stale_vintage (", F.year(vintage).cast("string"), ")")),
    )


def parse_issues(rates: list[Column], fixed: Column, confidence: Column) -> Column:
    """Issues of a parsed schedule with their values; none means valid."""
    text = lambda label, v: F.concat(F.lit(f"{label}:"), v.cast("double").cast("string"))
    flags: list[tuple[Column, Column | str]] = [(F.coalesce(rates[0], F.lit(0.0)) == 0, "no_tier_1_rate")]
    for k, rate in enumerate(rates, 1):
        flags += [(rate < 0.1, text(f"tier_{k}_rate_too_low", rate)), (rate > 50, text(f"tier_{k}_rate_too_high", rate))]
    return flag_list(*flags, (fixed > 500, text("fixed_charge_high", fixed)), (F.coalesce(confidence, F.lit("failed")) == "failed", "confidence_failed"))


def identical_bills(b5: Column, b10: Column, b20: Column, structure: Column) -> Column:
    """Three equal positive bills of a structure that isn't flat."""
    same = (b5 != 0) & (b10 != 0) & (b20 != 0) & (F.abs(b5 - b10) < 0.01) & (F.abs(b10 - b20) < 0.01)
    return F.coalesce(same & (structure != "flat"), F.lit(False))


def grade(bill: Column, n_tiers: Column) -> Column:
    """high, medium or low by the size of a bill and the number of tiers."""
    return F.when(bill.between(10, 200) & (n_tiers >= 2), "high").when(bill.between(5, 500), "medium").otherwise("low")


def display_flags(vintage: Column, low: Column, high: Column, as_of_year: int) -> Column:
    """struct<stale, high_variance>: a vintage two years old or more; a range above 20."""
    return F.struct(F.coalesce(F.year(vintage) <= as_of_year - 2, F.lit(False)).alias("stale"), F.coalesce(high - low > 20, F.lit(False)).alias("high_variance"))


def safe_number(text: Column, kind: str = "double") -> Column:
    """A number of a text with blanks, dollar signs and thousands marks; null for NA, an empty text and what is no number."""
    plain = F.trim(F.regexp_replace(text, r"[$,]", ""))
    return F.when(~F.upper(plain).isin("", "NA", "N/A", "NONE", "NAN"), plain).try_cast(kind)
