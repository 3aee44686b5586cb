"""Host-level quality rules in DataFrame functions only.

Each document gets base counts and fails rules of its own: few words, repeated windows (these two are the base
rule), many symbols, repeated lines. Failures are summed by host and rule; for each rule a host's failure rate is
shrunk towards a beta prior that is fitted to all hosts by moments. A host loses all its documents if by its shrunk
rate, less one standard deviation of its own beta distribution, most of them fail one and the same rule, and if the
rate is unlike the other hosts': above the prior's mean by a factor of TIMES.

Defined cases: a host of few documents stays near the prior; hosts that all fail alike are not unlike each other and
stay; null and empty texts have zero words and fail the base rule; a null host is a host of its own;
repeated rows count each; an empty table gives an empty table; columns of the input are kept unless named like
one of COUNTS, base_failed or kept, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, hold, materialise, n_words_column

#: Words of a repeat window, least words, largest percentage of repeated words, of symbols by words, of repeated lines.
WINDOW, LEAST_WORDS, MOST_REPEATED, MOST_SYMBOLS, MOST_DUP_LINES = 8, 20, 30, 10, 30
#: Shrunk rate above which a host goes, and multiple of the prior's mean that it must exceed as well.
HOST_RATE, TIMES = 0.5, 1.5
RULES = ("few_words", "repeats", "symbols", "dup_lines")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda variable is bound, never inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column, n: int = WINDOW) -> Column:
    """Words inside windows of ``n`` words (8) that occur twice or more in the array."""
    if n != 8:
        raise ValueError("three doublings name windows of 8 words")

    def covered(hashes: Column) -> Column:
        def marked(pairs: Column) -> Column:
            last = F.size(pairs)
            hash_at = lambda k: F.element_at(pairs, k)["h"]
            same = F.filter(
                F.transform(
                    F.sequence(F.lit(1), last),
                    lambda k: F.when(
                        ((k > 1) & (hash_at(F.greatest(k - 1, F.lit(1))) == hash_at(k))) | ((k < last) & (hash_at(F.least(k + 1, last)) == hash_at(k))),
                        F.element_at(pairs, k)["p"],
                    ),
                ),
                lambda p: p.isNotNull(),
            )
            start = F.struct(F.lit(-n).alias("at"), F.lit(0).alias("sum"))
            step = lambda acc, p: F.struct(p.alias("at"), (acc["sum"] + F.least(F.lit(n), p - acc["at"])).alias("sum"))
            return F.aggregate(F.array_sort(same), start, step, lambda acc: acc["sum"])

        pairs = F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("p")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(F.array_sort(pairs), marked))

    def doubled(h: Column, step: int) -> Column:
        """Names of twice as many words: each name with the one ``step`` places on."""
        count = F.size(h) - step
        return F.zip_with(F.slice(h, F.lit(1), count), F.slice(h, F.lit(1 + step), count), lambda a, b: F.xxhash64(a, b))

    def windows(w: Column) -> Column:
        named = F.transform(w, lambda x: F.xxhash64(x))
        return F.when(F.size(w) <= n, F.lit(0)).otherwise(_let(named, lambda a: _let(doubled(a, 1), lambda b: _let(doubled(b, 2), lambda c: _let(doubled(c, 4), covered)))))

    return _let(words, windows)


def base_counts(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``df`` with COUNTS and base_failed: one narrow pass."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SPACES + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    made = {
        "n_words": n_words_column(text_col),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": _let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
        "n_repeat_words": _repeat_words(words).cast("long"),
    }
    out = df.withColumns(made).withColumn("__lines", F.size(lines).cast("long"))
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def failures() -> dict[str, Column]:
    """Whether a counted document fails each of RULES."""
    return {
        "few_words": F.col("n_words") < LEAST_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("n_words"),
        "dup_lines": 100 * F.col("n_dup_lines") > MOST_DUP_LINES * F.col("__lines"),
    }


def host_verdicts(counted: DataFrame, *, host_col: str = "source", most: float = HOST_RATE, times: float = TIMES) -> DataFrame:
    """One row per host: host, n, a failure count and a shrunk rate by rule, host_kept.

    A prior is two numbers a rule, made from all hosts. With hosts of one rate it is as strong as the mean host.
    """
    fails = failures()
    hosts = counted.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(r) for r, c in fails.items()])
    hosts = materialise(hosts, "hosts")
    rate = lambda r: F.col(r) / F.col("n")
    moments = [x for r in fails for x in (F.avg(rate(r)).alias(f"m_{r}"), F.var_pop(rate(r)).alias(f"v_{r}"))]
    got = hosts.agg(F.avg("n").alias("n"), F.avg(1 / F.col("n")).alias("inv"), *moments).first()
    n, kept, out = got["n"] or 1.0, F.lit(True), hosts
    for r in fails:
        m = got[f"m_{r}"] or 0.0
        # the variance between hosts is what sampling of each host's documents does not explain
        between = (got[f"v_{r}"] or 0.0) - m * (1 - m) * (got["inv"] or 0.0)
        strength = min(n, m * (1 - m) / between - 1) if between > 0 and 0 < m < 1 else n
        strength = max(strength, 1.0)
        shrunk = (F.col(r) + m * strength) / (F.col("n") + strength)
        out = out.withColumn(f"rate_{r}", shrunk)
        sure = shrunk - F.sqrt(shrunk * (1 - shrunk) / (F.col("n") + strength + 1))
        kept = kept & ~((sure > most) & (shrunk > times * m))
    return out.withColumn("host_kept", kept)


def quality_rules(df: DataFrame, *, text_col: str = "text", host_col: str = "source", keep_text: bool = False) -> DataFrame:
    """``df`` (without the text unless ``keep_text``) with COUNTS, base_failed and kept.

    The counts are computed once and written; only failed hosts, from a written table whose size the planner
    knows, meet them again.
    """
    counted = base_counts(df, text_col=text_col)
    counted = hold(materialise(counted if keep_text else counted.drop(text_col), "counted"))
    bad = materialise(host_verdicts(counted, host_col=host_col).filter(~F.col("host_kept")).select(F.col("host").alias("__host"), F.lit(True).alias("__bad")), "bad-hosts")
    joined = counted.join(bad, counted[host_col].eqNullSafe(bad["__host"]), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("__bad").isNull()).drop("__host", "__bad", "__lines")
