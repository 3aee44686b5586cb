"""Tariff mathematics as Column expressions.

Tiers are array<struct<tier,min_gal,max_gal,rate_per_1000_gal>>, a null max_gal is unbounded; fixed charges are
array<struct<name,amount,meter_size>>; a bill curve is array<struct<gal,bill>> in ascending order of gal.
Amounts are rounded half up, as Spark's round does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import exact_round

#: Gallons of a hundred cubic feet and of a cubic foot. Sources differ, so it is always a parameter.
CCF_GALLONS, CCF_GALLONS_FINE, CUBIC_FOOT_GALLONS = 748.0, 748.052, 7.48052
#: Months of a billing period.
MONTHS = {"monthly": 1, "bimonthly": 2, "bi-monthly": 2, "quarterly": 3, "semi-annual": 6, "semi-annually": 6, "bi-annual": 6, "annual": 12, "annually": 12}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: a lambda variable is bound, never inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(items: Column, start: Column, step: Callable[[Column, Column], Column], end: Callable[[Column], Column] | None = None) -> Column:
    return F.aggregate(F.coalesce(items, F.slice(items, 1, 0)), start, step, end) if end else F.aggregate(items, start, step)


def ccf_to_gal(ccf: Column, per_ccf: float = CCF_GALLONS) -> Column:
    return exact_round(ccf * per_ccf, 0)


def rate_per_kgal(rate_per_ccf: Column, per_ccf: float = CCF_GALLONS) -> Column:
    return exact_round(rate_per_ccf * (1000.0 / per_ccf), 4)


def tier(number: Column, low: Column, high: Column, rate: Column) -> Column:
    return F.struct(number.cast("int").alias("tier"), low.cast("double").alias("min_gal"), high.cast("double").alias("max_gal"), rate.cast("double").alias("rate_per_1000_gal"))


def _some(array: Column) -> Column:
    return F.when(F.size(array) > 0, array)


def tiers_from_wide(limits: list[Column], rates: list[Column], *, per_ccf: float = CCF_GALLONS) -> Column:
    """Wide limit and rate columns to tiers: ends before the first null rate, or with the first null limit; no tier is null."""
    open_, low, rows = F.lit(True), F.lit(0.0), []
    for k, (limit, rate) in enumerate(zip(limits, rates, strict=True)):
        open_ = open_ & rate.isNotNull()
        high = ccf_to_gal(limit, per_ccf)
        rows.append(F.when(open_, tier(F.lit(k + 1), low, high, rate_per_kgal(rate, per_ccf))))
        open_, low = open_ & limit.isNotNull(), high
    return _some(F.array_compact(F.array(*rows)))


def fixed_charges(amount: Column, meter: Column) -> Column:
    """The service charge as an array; null for a null or zero amount."""
    one = F.struct(F.lit("Service Charge").alias("name"), exact_round(amount.cast("double"), 2).alias("amount"), meter.cast("string").alias("meter_size"))
    return F.when(amount != 0, F.array(one))


def fixed_monthly(charges: Column) -> Column:
    """Sum of the amounts; 0 without charges."""
    return F.coalesce(F.aggregate(charges, F.lit(0.0), lambda a, x: a + F.coalesce(x["amount"], F.lit(0.0))), F.lit(0.0))


def volumetric_charge(tiers: Column, gallons: Column, *, extend_last: bool = False) -> Column:
    """Volume is used up tier by tier in their order; what the last bounded tier leaves is dropped, or billed at its rate."""
    start = F.struct(F.lit(0.0).alias("sum"), gallons.cast("double").alias("left"), F.lit(0.0).alias("rate"))

    def step(s: Column, t: Column) -> Column:
        rate = F.coalesce(t["rate_per_1000_gal"], F.lit(0.0))
        wide = t["max_gal"] - F.coalesce(t["min_gal"], F.lit(0.0))
        used = F.when(s["left"] <= 0, F.lit(0.0)).otherwise(F.least(s["left"], F.coalesce(wide, s["left"])))
        return F.struct((s["sum"] + used / 1000.0 * rate).alias("sum"), (s["left"] - used).alias("left"), rate.alias("rate"))

    end = (lambda s: s["sum"] + F.greatest(s["left"], F.lit(0.0)) / 1000.0 * s["rate"]) if extend_last else (lambda s: s["sum"])
    return F.coalesce(F.aggregate(F.array_sort(tiers), start, step, end), F.lit(0.0))


def bill(fixed: Column, tiers: Column, gallons: Column, *, mode: str = "schedule") -> Column:
    """Bill at ``gallons``, rounded to cents. Modes: ``schedule`` (not positive: null), ``extend`` (the last rate goes on),
    ``fixed_only`` (no tiers: the fixed charge), ``strict`` (no tiers: null)."""
    empty = tiers.isNull() | (F.size(tiers) == 0)
    total = F.coalesce(fixed, F.lit(0.0)) + volumetric_charge(tiers, gallons, extend_last=mode == "extend")
    total = F.when(total > 0, total) if mode == "schedule" else F.when(~empty, total) if mode == "strict" else total
    return exact_round(total, 2)


def bill_by_limits(fixed: Column, pairs: Column, ccf: Column) -> Column:
    """Bill from array<struct<limit,rate>> in CCF; a null limit is open, the last rate goes on, no pairs: null."""
    valid = F.filter(pairs, lambda p: p["rate"].isNotNull())
    start = F.struct(F.coalesce(fixed, F.lit(0.0)).alias("sum"), ccf.cast("double").alias("left"), F.lit(0.0).alias("low"), F.lit(0.0).alias("rate"))

    def step(s: Column, p: Column) -> Column:
        used = F.when(s["left"] <= 0, F.lit(0.0)).otherwise(F.least(s["left"], F.coalesce(p["limit"] - s["low"], s["left"])))
        low = F.when(s["left"] > 0, F.coalesce(p["limit"], s["low"])).otherwise(s["low"])
        return F.struct((s["sum"] + used * p["rate"]).alias("sum"), (s["left"] - used).alias("left"), low.alias("low"), p["rate"].alias("rate"))

    total = F.aggregate(valid, start, step, lambda s: s["sum"] + F.greatest(s["left"], F.lit(0.0)) * s["rate"])
    return F.when(F.size(valid) > 0, exact_round(total, 2))


def conservation_signal(tiers: Column, digits: int = 2) -> Column:
    """Highest over lowest rate of the tiers with one; null for fewer than two or a lowest that isn't positive."""
    rates = F.transform(F.filter(tiers, lambda t: F.coalesce(t["rate_per_1000_gal"], F.lit(0.0)) != 0), lambda t: t["rate_per_1000_gal"])
    return F.when((F.size(rates) >= 2) & (F.array_min(rates) > 0), exact_round(F.array_max(rates) / F.array_min(rates), digits))


def structure_type(rates: Column, *, decreasing_first: bool = False) -> Column:
    """flat, uniform, increasing_block or decreasing_block of a list of rates; a mixed list counts as increasing."""
    pairs = F.arrays_zip(F.slice(rates, F.lit(1), F.greatest(F.size(rates) - 1, F.lit(0))).alias("a"), F.slice(rates, 2, F.greatest(F.size(rates) - 1, F.lit(0))).alias("b"))
    up, down = F.forall(pairs, lambda p: p["a"] <= p["b"]), F.forall(pairs, lambda p: p["a"] >= p["b"])
    many = F.when(down if decreasing_first else ~up & down, "decreasing_block").otherwise("increasing_block")
    return F.when(F.coalesce(F.size(rates), F.lit(0)) <= 0, "flat").when(F.size(rates) == 1, "uniform").otherwise(many)


def curve_of(bills: Column) -> Column:
    """A map of gallons (text) to bill (text or number) as a curve; entries that are no numbers are left out."""
    entries = F.transform(F.map_entries(bills), lambda e: F.struct(e["key"].try_cast("long").alias("gal"), e["value"].try_cast("double").alias("bill")))
    return F.array_sort(F.filter(entries, lambda e: e["gal"].isNotNull() & e["bill"].isNotNull()))


def marginal_rates(curve: Column) -> Column:
    """array<struct<gal,rate>>: dollars per 1000 gallons from each point of a curve to the next."""
    after = F.slice(curve, 2, F.greatest(F.size(curve) - 1, F.lit(0)))
    before = F.slice(curve, F.lit(1), F.greatest(F.size(curve) - 1, F.lit(0)))
    made = F.zip_with(before, after, lambda a, b: F.struct(a["gal"].alias("gal"), ((b["bill"] - a["bill"]) / ((b["gal"] - a["gal"]) / 1000.0)).alias("rate")))
    return F.filter(made, lambda m: m["rate"].isNotNull())


def islands(rates: Column, tolerance: float) -> Column:
    """array<struct<gal,rate>>: consecutive rates within ``tolerance`` of the first of their island stand for one."""
    none = F.slice(rates, 1, 0)
    return F.aggregate(rates, none, lambda kept, m: F.when((F.size(kept) > 0) & (F.abs(m["rate"] - F.element_at(kept, -1)["rate"]) <= tolerance), kept).otherwise(F.concat(kept, F.array(m))))


def tiers_of_curve(curve: Column, tolerance: float = 0.05) -> Column:
    """array<struct<start_gal,end_gal,rate_per_kgal,is_allowance>>: islands of equal marginal rates."""

    def made(kept: Column) -> Column:
        ends = F.concat(F.slice(F.transform(kept, lambda m: m["gal"]), 2, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(F.lit(None).cast("long")))
        return F.zip_with(kept, F.slice(ends, F.lit(1), F.size(kept)), lambda m, e: F.struct(m["gal"].alias("start_gal"), e.alias("end_gal"), m["rate"].alias("rate_per_kgal"), (m["rate"] < tolerance).alias("is_allowance")))

    return let(islands(marginal_rates(curve), tolerance), made)


def four_tiers(tiers: Column, divisor: Column, per_ccf: float = CCF_GALLONS_FINE) -> Column:
    """struct<tiers array<struct<limit_ccf,rate>>, overflow_note> of curve tiers: tiers past the fourth collapse into it with the last rate."""
    kept = F.filter(tiers, lambda t: ~t["is_allowance"])

    def made(v: Column) -> Column:
        over = F.size(v) > 4
        rows = F.transform(
            F.slice(v, 1, 4),
            lambda t, k: F.when(over & (k == 3), F.struct(F.lit(None).cast("double").alias("limit_ccf"), exact_round(F.element_at(v, -1)["rate_per_kgal"] * per_ccf / 1000, 4).alias("rate"))).otherwise(
                F.struct(exact_round(t["end_gal"] / per_ccf / divisor, 2).alias("limit_ccf"), exact_round(t["rate_per_kgal"] * per_ccf / 1000, 4).alias("rate"))
            ),
        )
        note = F.when(over, F.format_string("EFC bill curve shows %d volumetric tiers; tiers 4+ collapsed into tier 4", F.size(v)))
        return F.struct(rows.alias("tiers"), note.alias("overflow_note"))

    return let(kept, made)


def bill_from_curve(curve: Column, ccf: Column, divisor: Column, *, per_ccf: float = CCF_GALLONS_FINE, snap: float = 0.10, extrapolate: bool = False) -> Column:
    """Monthly bill at ``ccf`` a month from a curve per billing period.

    Within ``snap`` of the increment a point is taken as it is, else the two around it are interpolated; beyond the
    last point: null, or with ``extrapolate`` the last slope goes on (then without snapping).
    """
    gal = ccf * per_ccf * divisor

    def made(c: Column) -> Column:
        above, below = F.get(F.filter(c, lambda p: p["gal"] >= gal), F.lit(0)), F.try_element_at(F.filter(c, lambda p: p["gal"] < gal), F.lit(-1))
        step = above["gal"] - below["gal"]
        line = below["bill"] + (gal - below["gal"]) / step * (above["bill"] - below["bill"])
        inside = line
        if not extrapolate:
            inside = F.when(gal - below["gal"] <= step * snap, below["bill"]).when(above["gal"] - gal <= step * snap, above["bill"]).otherwise(line)
        last, before = F.try_element_at(c, F.lit(-1)), F.try_element_at(c, F.lit(-2))
        beyond = last["bill"] + (last["bill"] - before["bill"]) / (last["gal"] - before["gal"]) * (gal - last["gal"]) if extrapolate else F.lit(None).cast("double")
        value = F.when(F.size(c) <= 0, None).when(above.isNull(), beyond).when(below.isNull(), above["bill"]).otherwise(inside)
        return exact_round(value / divisor, 2)

    return let(curve, made)


def divisor_of(frequency: Column) -> Column:
    """Months of a billing period; an unknown one counts as monthly."""
    table = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(frequency))), F.lit(1))


def per_month(amount: Column, frequency: Column) -> Column:
    return amount / divisor_of(frequency)


def tiers_per_month(tiers: Column, frequency: Column) -> Column:
    """Tier bounds of a billing period as bounds of a month; rates stay."""
    d = divisor_of(frequency)
    return F.transform(tiers, lambda t: tier(t["tier"], t["min_gal"] / d, t["max_gal"] / d, t["rate_per_1000_gal"]))


def two_point_model(minimum: Column, low: Column, high: Column, *, low_gal: float = 3400.0, high_gal: float = 4000.0, per_ccf: float = CCF_GALLONS_FINE) -> Column:
    """struct<structure_type, rate_per_kgal, fixed, bill_5ccf, bill_10ccf> from the bills at two volumes.

    A falling bill gives the mean rate, no slope a flat bill, a rising one a uniform rate with the intercept as fixed
    charge (the minimum where it is negative); with the higher bill alone all is proportional.
    """
    slope, mean = (high - low) / (high_gal - low_gal), high / high_gal
    intercept = high - slope * high_gal
    fixed = F.when(intercept >= 0, exact_round(intercept, 2)).otherwise(minimum)
    at = lambda n: exact_round(F.coalesce(fixed, F.lit(0.0)) + slope * n * per_ccf, 2)
    share = lambda n: exact_round(high * (n * per_ccf / high_gal), 2)

    def row(kind: str, rate: Column, fix: Column, five: Column, ten: Column) -> Column:
        return F.struct(F.lit(kind).alias("structure_type"), rate.alias("rate_per_kgal"), fix.cast("double").alias("fixed"), five.alias("bill_5ccf"), ten.alias("bill_10ccf"))

    none, both = F.lit(None).cast("double"), low.isNotNull() & high.isNotNull()
    return (
        F.when(both & (slope < 0), row("decreasing_block", exact_round(mean * 1000, 2), F.coalesce(minimum, F.lit(0.0)), share(5), share(10)))
        .when(both & (F.abs(slope) < 0.0001), row("flat", none, exact_round(high, 2), exact_round(high, 2), exact_round(high, 2)))
        .when(both, row("uniform", exact_round(slope * 1000, 2), fixed, at(5), at(10)))
        .when(high.isNotNull(), row("uniform", none, minimum, share(5), share(10)))
    )


def bills_from_5k_10k(b5k: Column, b10k: Column, per_ccf: float = CCF_GALLONS) -> Column:
    """struct<bill_5ccf, bill_10ccf, bill_20ccf, method> from bills at 5000 and 10000 gallons; with the first alone in proportion."""
    slope, fixed = (b10k - b5k) / 5000.0, 2 * b5k - b10k
    one = b5k * (5 * per_ccf / 5000.0)
    both = b5k.isNotNull() & b10k.isNotNull()
    pick = lambda n: exact_round(F.when(both, fixed + slope * n * per_ccf).when(b10k.isNull() & (n <= 10), one * (n / 5)), 2)
    method = F.when(both, "interpolated_2pt_linear").when(b5k.isNotNull(), "extrapolated_1pt")
    return F.struct(pick(5).alias("bill_5ccf"), pick(10).alias("bill_10ccf"), pick(20).alias("bill_20ccf"), method.alias("method"))


def proportional_20ccf(b10: Column, b20: Column) -> Column:
    """The bill at 20 CCF, or twice that at 10 where it is missing."""
    return F.coalesce(b20, exact_round(2 * b10, 2))


def bill_outliers(b10: Column, low: float = 5.0, high: float = 200.0) -> Column:
    """Reasons to review a bill, joined by "; "; null without one."""
    text = F.concat_ws("; ", F.when(b10 > high, F.format_string(f"bill_10ccf=$%.2f > ${high:.0f}", b10)), F.when(b10 < low, F.format_string(f"bill_10ccf=$%.2f < ${low:.0f}", b10)))
    return F.nullif(text, F.lit(""))


def cubic_tier(low: Column, high: Column, base: Column, cost: Column, adjustment: Column, *, cubic: Column, unlimited: float = 1e9, per_foot: float = CUBIC_FOOT_GALLONS) -> Column:
    """struct<min_gal,max_gal,rate_per_1000_gal> of a row in cubic feet or gallons, ``cost`` per ``base`` units; null without cost or base."""
    unit = F.when(cubic, F.lit(per_foot)).otherwise(F.lit(1.0))
    adj = F.when(F.coalesce(adjustment, F.lit(0.0)) == 0, 1.0).otherwise(adjustment)
    top = F.when((high != 0) & (high < unlimited), exact_round(high * unit, 0))
    return F.when((base > 0) & cost.isNotNull(), F.struct(exact_round(F.coalesce(low, F.lit(0.0)) * unit, 0).alias("min_gal"), top.alias("max_gal"), exact_round(cost * adj / (base * unit / 1000.0), 4).alias("rate_per_1000_gal")))


def numbered(rows: Column) -> Column:
    """Tiers of array<struct<min_gal,max_gal,rate_per_1000_gal>>: sorted, equal ones once, made contiguous and numbered."""
    kept = F.array_distinct(F.array_sort(rows))
    return let(kept, lambda a: F.transform(a, lambda t, k: tier(k + 1, F.when(k > 0, F.coalesce(F.get(a, F.greatest(k - 1, F.lit(0)))["max_gal"], t["min_gal"])).otherwise(t["min_gal"]), t["max_gal"], t["rate_per_1000_gal"])))


def close_gaps(tiers: Column, gap: float = 1.0) -> Column:
    """Each tier begins where the one before ends, if that is exactly ``gap`` away."""
    before = lambda k: F.get(tiers, F.greatest(k - 1, F.lit(0)))["max_gal"]
    return F.transform(tiers, lambda t, k: tier(t["tier"], F.when((k > 0) & (t["min_gal"] - before(k) == gap), before(k)).otherwise(t["min_gal"]), t["max_gal"], t["rate_per_1000_gal"]))


def tiers_from_parsed(tiers: Column, ccf_unit: Column, per_ccf: float = CCF_GALLONS_FINE) -> Column:
    """Tiers of array<struct<from_gal,to_gal,rate>> with a rate per gallon, or per CCF with bounds in CCF; unpriced ones are left out."""
    unit = F.when(ccf_unit, F.lit(per_ccf)).otherwise(F.lit(1.0))
    priced = F.filter(tiers, lambda t: t["rate"].isNotNull())
    rows = F.transform(priced, lambda t, k: tier(k + 1, exact_round(F.coalesce(t["from_gal"], F.lit(0.0)) * unit, 0), F.when(t["to_gal"] != 0, exact_round(t["to_gal"] * unit, 0)), exact_round(t["rate"] / unit * 1000, 4)))
    return let(rows, lambda a: close_gaps(a))


def tiers_from_lines(starts: Column, prices: Column, kgal: Column, per_ccf: float = CCF_GALLONS) -> Column:
    """array<struct<limit_ccf,rate_ccf>> of two texts with a value a line; a start that is no number makes all limits null,
    a price that is none gives no tier, and the longer list is cut."""
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    numbers = lambda c: F.transform(lines(c), lambda x: x.try_cast("double"))
    price_unit, limit_unit = F.when(kgal, F.lit(per_ccf / 1000)).otherwise(1.0), F.when(kgal, F.lit(1000 / per_ccf)).otherwise(1.0)

    def made(both: Column) -> Column:
        a, p = both["starts"], both["prices"]
        count = F.when(F.exists(a, lambda x: x.isNull()), F.size(p)).otherwise(F.least(F.size(a), F.size(p)))
        top = lambda k: F.when(~F.exists(a, lambda x: x.isNull()) & (k + 1 < count), exact_round(F.get(a, k + 1) * limit_unit, 2))
        rows = F.transform(F.slice(p, F.lit(1), count), lambda x, k: F.struct(top(k).alias("limit_ccf"), exact_round(x * price_unit, 4).alias("rate_ccf")))
        return F.when((starts == "") | (prices == "") | F.exists(p, lambda x: x.isNull()), F.slice(rows, 1, 0)).otherwise(rows)

    return F.when(starts.isNull() | prices.isNull(), F.from_json(F.lit("[]"), "array<struct<limit_ccf:double,rate_ccf:double>>")).otherwise(let(F.struct(numbers(starts).alias("starts"), numbers(prices).alias("prices")), made))


def without_key(charges: Column, keep: list[str]) -> Column:
    """Each struct of an array with the fields ``keep`` alone."""
    return F.transform(charges, lambda c: F.struct(*[c[k].alias(k) for k in keep]))


def with_line_item(charges: Column, name: str, amount: Column, notes: Column, tag: str) -> Column:
    """The charges with one more, unless the notes carry the tag of it already."""
    one = F.struct(F.lit(name).alias("name"), amount.cast("double").alias("amount"), F.lit(None).cast("string").alias("meter_size"))
    return F.when(F.coalesce(notes, F.lit("")).contains(tag), charges).otherwise(F.concat(F.coalesce(charges, F.slice(F.array(one), 1, 0)), F.array(one)))


def audit(tiers: Column) -> Column:
    """struct<n, gap, repeated, unbounded_inside> of an array of tiers."""
    pairs = F.zip_with(F.slice(tiers, F.lit(1), F.greatest(F.size(tiers) - 1, F.lit(0))), F.slice(tiers, 2, F.greatest(F.size(tiers) - 1, F.lit(0))), lambda a, b: F.struct(a["max_gal"].alias("end"), b["min_gal"].alias("next")))
    plain = F.transform(tiers, lambda t: F.struct(t["min_gal"], t["max_gal"], t["rate_per_1000_gal"]))
    return F.struct(
        F.coalesce(F.size(tiers), F.lit(0)).alias("n"),
        F.coalesce(F.exists(pairs, lambda p: p["end"].isNotNull() & (p["end"] != p["next"])), F.lit(False)).alias("gap"),
        F.coalesce(F.size(F.array_distinct(plain)) < F.size(plain), F.lit(False)).alias("repeated"),
        F.coalesce(F.exists(pairs, lambda p: p["end"].isNull()), F.lit(False)).alias("unbounded_inside"),
    )


def has_tier_above(tiers: Column, gallons: float) -> Column:
    return F.coalesce(F.exists(tiers, lambda t: F.coalesce(t["max_gal"], F.lit(0.0)) > gallons), F.lit(False))


def inflated_repair(tiers: Column, bills: dict[str, Column], *, most_gal: float = 74_800.0, most: float = 500.0, least_12: float = 2.0) -> dict[str, Column]:
    """Tiers with a bound above ``most_gal`` go; so do the bills if one is above ``most`` or that at 12 CCF is below ``least_12``."""
    bad = has_tier_above(tiers, most_gal)
    suspect = F.coalesce(bills["bill_12ccf"] < least_12, F.lit(False))
    for b in bills.values():
        suspect = suspect | F.coalesce(b > most, F.lit(False))
    out = {"volumetric_tiers": F.when(~bad, tiers), "confidence": F.when(bad & suspect, "low").when(bad, "medium")}
    return out | {name: F.when(~(bad & suspect), b) for name, b in bills.items()}


def percent_change(old: Column, new: Column) -> Column:
    return F.when(old > 0, (new - old) / old * 100)


def decimal_repair(value: Column, most: float = 500.0, least: float = 10.0) -> Column:
    """A value above ``most`` divided by 100 if that is plausible, else null."""
    return F.when(value <= most, value).when((value / 100 > least) & (value / 100 < most), value / 100).when(value.isNull(), value)


def curve_of_columns(bills: dict[int, Column]) -> Column:
    """A bill curve (array<struct<gal,bill>>) of wide columns by their gallons, up to the first that is no number."""
    points = F.array(*[F.struct(F.lit(gal).cast("long").alias("gal"), bill.try_cast("double").alias("bill")) for gal, bill in sorted(bills.items())])
    return let(points, lambda p: F.slice(p, F.lit(1), F.coalesce(F.nullif(F.array_position(F.transform(p, lambda x: x["bill"].isNull()), True), F.lit(0)) - 1, F.size(p).cast("long")).cast("int")))
