"""Mixing sources to target weights by hash-threshold histograms.

Each document has a 64-bit hash of its id. Sizes are summed by source and the hash's leading bits; the bucket in
which a source's budget runs out is found in the running sums, and only that bucket is refined by the next bits,
until the 64 bits are used or nothing is left to split. A document is then taken by comparing its hash with its
source's threshold: nothing is sorted. A target above the source's size takes everything once and the excess by
the threshold again.

Defined cases: null texts have size 0 and are never counted; a null source is a source of its own and comes last;
rows of one id share a hash and are decided together; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, n_words_column

#: Weights by rank of the source, repeating; share of all sizes; largest multiple of a source's size; bits a round.
WEIGHTS, SHARE, MOST, BITS = (3, 1, 2), 1.5, 2.0, 12


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Target of each source: ``share`` of all sizes by weight, at ``most`` times its size; excess goes to the others by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    cap = {s: most * n for s, n in order}
    left, out, free = share * sum(n for _, n in order), {}, [s for s, _ in order]
    while free:
        total = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / total > cap[s]]
        if not above:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: cap[s] for s in above}
        left -= sum(cap[s] for s in above)
        free = [s for s in free if s not in out]
    return out


def _thresholds(narrow: DataFrame, budgets: DataFrame) -> DataFrame:
    """(k, cut): hashes below ``cut`` (unsigned, as 16 digits) fit the budget; the last one goes in if that is nearer."""
    # state: prefix so far (hexadecimal digits), what is left of the budget, hashes in the prefix
    state = budgets.select("k", F.lit("").alias("prefix"), F.col("budget").cast("double").alias("left"))
    step = BITS // 4
    for depth in range(0, 16, step):
        digits = min(step, 16 - depth)
        rows = narrow if depth == 0 else narrow.join(state.select(F.col("k").alias("sk"), "prefix"), (F.col("k") == F.col("sk")) & F.col("h").startswith(F.col("prefix")))
        # the hot source is pre-aggregated before the shuffle: at most 4096 sums of a source come from a task
        sums = rows.groupBy("k", F.substring("h", 1, depth + digits).alias("bucket")).agg(F.sum("size").alias("words"), F.count_distinct("h").alias("hashes") if depth else F.lit(2).alias("hashes"))
        run = sums.join(state.select(F.col("k").alias("sk"), "left"), F.col("k") == F.col("sk"))
        over = Window.partitionBy("k").orderBy("bucket")
        run = run.withColumn("upto", F.sum("words").over(over)).filter(F.col("upto") > F.col("left"))
        first = run.groupBy("k").agg(F.min_by(F.struct("bucket", "words", "upto", "left", "hashes"), "bucket").alias("x"))
        state = materialise(first.select("k", F.col("x.bucket").alias("prefix"), (F.col("x.left") - (F.col("x.upto") - F.col("x.words"))).alias("left"), F.col("x.words").alias("words"), F.col("x.hashes").alias("hashes")), "thresholds")
        if state.filter("hashes > 1").isEmpty():
            break
    # one hash is left in the prefix: take it if that comes nearer to the budget
    return state.select("k", F.col("prefix"), (F.col("left") * 2 > F.col("words")).alias("last"))


def mix(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``df`` with size, source_size, target, copies, taken: whole documents, ``copies`` times each, 2 at most. Columns of these names are replaced.

    Sources are a configuration of the mix: their list (names and sizes) is the only thing the driver holds.
    """
    hashed = F.lower(F.lpad(F.hex(F.xxhash64(F.lit("mix"), F.col(id_col).cast("string"))), 16, "0"))
    narrow = materialise(df.select(F.col(id_col), F.col(source_col).alias("source"), n_words_column(text_col).alias("size"), hashed.alias("h")), "sizes")
    spark = df.sparkSession
    sizes = [(r["source"], r["n"]) for r in narrow.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    aim = targets(sizes)
    rows = [(k, s, int(n), float(aim[s]), float(aim[s] - n * (1 if aim[s] >= n else 0)), int(aim[s] >= n)) for k, (s, n) in enumerate(sizes)]
    table = materialise(spark.createDataFrame(rows, "k int, s string, source_size long, target double, budget double, whole int"), "targets")
    keyed = narrow.join(table.select("k", "s"), narrow["source"].eqNullSafe(F.col("s"))).select("k", "h", "size").filter("size > 0")
    cuts = _thresholds(keyed, table.select("k", "budget"))
    plan = materialise(table.join(cuts.withColumnRenamed("k", "ck"), F.col("k") == F.col("ck"), "left"), "plan")
    # no cut: the budget holds all of the source. The plan, a row a source, goes to the documents; nothing else is joined
    plan = plan.select(*[F.col(c).alias(f"__{c}") for c in plan.columns])
    head = F.expr("substring(__h, 1, length(__prefix))")
    below = F.when(F.col("__prefix").isNull(), F.col("__budget") > 0).otherwise((head < F.col("__prefix")) | ((head == F.col("__prefix")) & F.col("__last")))
    copies = F.col("__whole") + below.cast("int")
    rows = df.withColumns({"__h": hashed, "__size": n_words_column(text_col)})
    out = rows.join(plan, rows[source_col].eqNullSafe(F.col("__s")))
    discard(narrow)
    result = {"size": F.col("__size"), "source_size": F.col("__source_size"), "target": F.col("__target"), "copies": copies, "taken": (copies * F.col("__size")).cast("long")}
    kept = [c for c in df.columns if c not in result]
    return out.select(*[rows[c] for c in kept], *[c.alias(name) for name, c in result.items()])
