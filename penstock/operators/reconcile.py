"""Cross-source reconciliation: spread, classes, causes, comparisons and parity reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import product_round


def bucket_right(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Classes (edge, next edge]; the last is open. A value at or below the first edge is in none."""
    out = F.when(value > edges[-1], labels[-1])
    for k in range(len(edges) - 2, -1, -1):
        out = F.when((value > edges[k]) & (value <= edges[k + 1]), labels[k]).otherwise(out)
    return out


def bucket_left(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Classes [edge, next edge): ``labels`` has one more, the first, for what is below the first edge."""
    out = F.when(value >= edges[-1], labels[-1])
    for edge, label in list(zip(edges, labels))[::-1]:
        out = F.when(value < edge, label).otherwise(out)
    return out


#: Classes of the coefficient of variation in percent.
CV_EDGES, CV_LABELS = [0.0, 10.0, 25.0, 50.0, 100.0], ["<10% agree", "10-25% moderate", "25-50% divergent", "50-100% major", ">100% conflict"]


def variance(df: DataFrame, *, key: str = "pwsid", threshold: float = 25.0) -> DataFrame:
    """Per key with two sources or more: spread, cv in percent (population), sources, causes and class.

    ``df`` has key, source, bill, vintage and flags (array<string>). A mean of zero or less has a cv of zero, which is
    in no class. One aggregate: sources and flags of a key are sets of a few names.
    """
    rows = df.filter("bill is not null")
    has = lambda text: F.max(F.exists("flags", lambda f: f.contains(text)))
    out = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_records"), F.avg("bill").alias("mean"), F.min("bill").alias("low"), F.max("bill").alias("high"), F.stddev_pop("bill").alias("sd"), F.array_sort(F.collect_set("source")).alias("names"),
        F.max(F.size("flags") > 0).alias("has_quality_flags"), has("ear_tier_limit_inflated").alias("ear"), has("bill_suspiciously_high").alias("combined"), has("stale_vintage").alias("stale"), has("bill_suspiciously_low").alias("odd"),
        (F.datediff(F.max("vintage"), F.min("vintage")) / 365.25).alias("years"),
    )
    out = out.filter(F.size("names") > 1).withColumn("cv", F.when(F.col("mean") > 0, F.col("sd") / F.col("mean") * 100).otherwise(0.0))
    found = [F.when(F.col(c), label) for c, label in (("ear", "eAR_tier_inflation"), ("combined", "possible_combined_charges"), ("stale", "stale_vintage"), ("odd", "data_quality_low"))]
    found.append(F.when(F.col("years") > 3, F.concat(F.lit("vintage_gap_"), F.bround("years", 0).cast("int").cast("string"), F.lit("yr"))))
    causes = F.concat_ws("; ", *found)
    causes = F.when(causes != "", causes).when(F.col("cv") > threshold, "unexplained").otherwise("within_tolerance")
    return out.select(
        key, F.size("names").alias("n_sources"), F.array_join("names", ", ").alias("sources"), "n_records", product_round(F.col("mean"), 2).alias("mean_bill"), product_round(F.col("low"), 2).alias("min_bill"), product_round(F.col("high"), 2).alias("max_bill"), product_round(F.col("high") - F.col("low"), 2).alias("spread"),
        product_round(F.col("cv"), 1).alias("cv_pct"), "has_quality_flags", causes.alias("divergence_causes"),
    ).withColumn("class", bucket_right(F.col("cv_pct"), CV_EDGES, CV_LABELS))


def tag_counts(df: DataFrame, tags: Column) -> DataFrame:
    """(tag, n) of an array column."""
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def combined_suspects(df: DataFrame, *, key: str = "pwsid", scraped: str = "scraped_llm", reasonable: float = 500.0) -> DataFrame:
    """Keys whose scraped bill is above 40 and above 1.5 times the median of the other sources' reasonable bills."""
    own, other = F.col("source") == scraped, F.col("source") != scraped
    out = df.filter("bill is not null").groupBy(key).agg(F.min_by("bill", F.when(own, F.col("id"))).alias("scraped_bill"), F.percentile(F.when(other & (F.col("bill") < reasonable), F.col("bill")), F.lit(0.5)).alias("other_median"))
    out = out.filter((F.col("scraped_bill") > 1.5 * F.col("other_median")) & (F.col("scraped_bill") > 40))
    return out.withColumn("ratio", F.round(F.col("scraped_bill") / F.col("other_median"), 2))


def overlap(df: DataFrame, left: Column, right: Column, *, key: str = "pwsid") -> DataFrame:
    """(key, a, b, pct_diff, abs_diff): the first bills of two sources of a key, in one aggregate in place of a self join."""
    first = lambda c: F.min_by("bill", F.when(c & F.col("bill").isNotNull(), F.col("id")))
    out = df.groupBy(key).agg(first(left).alias("a"), first(right).alias("b")).filter("a > 0 and b is not null")
    return out.withColumn("pct_diff", (F.col("b") - F.col("a")) / F.col("a") * 100).withColumn("abs_diff", F.abs("pct_diff"))


def agreement_report(pairs: DataFrame, *by: str) -> DataFrame:
    """Per group: n, median difference, counts in left-closed classes, direction of the large ones."""
    count = lambda lo, hi: F.count_if((F.col("abs_diff") >= lo) & (F.col("abs_diff") < hi))
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.percentile("pct_diff", F.lit(0.5)).alias("median_diff"), count(0, 10).alias("lt10"), count(10, 25).alias("b10_25"), count(25, 50).alias("b25_50"), count(50, float("inf")).alias("gt50"),
        F.count_if((F.col("abs_diff") >= 50) & (F.col("pct_diff") > 0)).alias("higher"), F.avg("a").alias("avg_a"), F.avg("b").alias("avg_b"),
    )


def compare_runs(before: DataFrame, after: DataFrame, key: str, length: str) -> DataFrame:
    """(key, old, new, outcome) of texts' lengths from one run to the next; a missing length is 0, keys of the second run count.

    recovered: from under 200 to 500 or more; improved: more than doubled, but still under 500; degraded: shorter.
    """
    b, a = before.select(key, F.col(length).alias("__old")), after.select(key, F.col(length).alias("__new"))
    old, new = F.coalesce("__old", F.lit(0)), F.coalesce("__new", F.lit(0))
    outcome = F.when((old < 200) & (new >= 500), "recovered").when((new > 2 * old) & (new < 500), "improved").when((new < old) & (old > 0), "degraded").otherwise("unchanged")
    return a.join(b, key, "left").select(key, old.alias("old"), new.alias("new"), outcome.alias("outcome"))


def parity(a: DataFrame, b: DataFrame, by: str, key: str) -> DataFrame:
    """(by, rows and keys of both tables, gap): a full outer join of two counts; a missing side counts zero."""
    count = lambda df, side: df.groupBy(F.col(by).alias("__by")).agg(F.count(F.lit(1)).alias(f"rows_{side}"), F.count_distinct(key).alias(f"keys_{side}"))
    out = count(a, "a").join(count(b, "b"), "__by", "full").fillna(0)
    return out.withColumnRenamed("__by", by).withColumn("gap", F.col("rows_a") - F.col("rows_b"))


def error_classes(pairs: DataFrame) -> DataFrame:
    """One row: how many pairs fall into each class of gross errors of the first side (a), the second (b, b5, b20) being the yardstick.

    factor: differs by 400 % or more, of these higher and lower; missing: none or 0 where the yardstick is over 5;
    high_low: over 500 against under 100; steep: said to be flat or uniform, but the yardstick's bill at 20 CCF is over
    2.5 times that at 5 (1 at least); large: over 200, of these agreeing (under 25 %) and not (50 % or more). Only
    missing counts pairs without both bills.
    """
    a, b = F.col("a"), F.col("b")
    valid = (a > 0) & (b > 0)
    diff = (a - b) / F.nullif(b, F.lit(0.0)) * 100
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return pairs.agg(
        count(valid & (F.abs(diff) >= 400)).alias("factor"), count(valid & (diff >= 400)).alias("higher"), count(valid & (diff <= -400)).alias("lower"), count((a.isNull() | (a == 0)) & (b > 5)).alias("missing"), count(valid & (a > 500) & (b < 100)).alias("high_low"),
        count(valid & F.col("structure").isin("flat", "uniform") & (F.col("b20") / F.greatest(F.col("b5"), F.lit(1.0)) > 2.5) & F.col("b5").isNotNull()).alias("steep"),
        count(valid & (a > 200)).alias("large"), count(valid & (a > 200) & (F.abs(diff) < 25)).alias("large_agreed"), count(valid & (a > 200) & (F.abs(diff) >= 50)).alias("large_apart"),
    )


#: Least pairs of a group, and the median and shares from which its differences are systematic.
BIAS_PAIRS, BIAS_MEDIAN, BIAS_SHARES = 5, 20, (30, 70)


def group_bias(pairs: DataFrame, by: str) -> DataFrame:
    """(by, n, median_diff, higher, systematic) of paired bills by group: whether the second side (b) differs from the first (a) in one direction.

    Groups of under BIAS_PAIRS are left out, as are pairs without two positive bills.
    """
    diff = (F.col("b") - F.col("a")) / F.col("a") * 100
    out = pairs.filter("a > 0 and b > 0").groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.percentile(diff, F.lit(0.5)).alias("median_diff"), (100 * F.count_if(diff > 0) / F.count(F.lit(1))).alias("__up")).filter(F.col("n") >= BIAS_PAIRS)
    systematic = (F.abs("median_diff") > BIAS_MEDIAN) & ((F.col("__up") > BIAS_SHARES[1]) | (F.col("__up") < BIAS_SHARES[0]))
    return out.select(by, "n", "median_diff", F.when(F.col("median_diff") > 0, "b").otherwise("a").alias("higher"), systematic.alias("systematic"))
