"""Table maintenance on plain Parquet: upserts, inserts of missing rows, audit rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def last_of(new: DataFrame, keys: list[str], last_by: Column) -> DataFrame:
    """One row per key, null keys included: that of the highest ``last_by``."""
    names = [c for c in new.columns if c not in keys]
    if not names:
        return new.distinct()
    picked = new.groupBy(*keys).agg(F.max_by(F.struct(*names), last_by).alias("__x"))
    return picked.select(*keys, *[F.col(f"__x.`{c}`").alias(c) for c in names])


def upsert(target: DataFrame, new: DataFrame, keys: list[str], *, coalesce: bool = False, keep_where_null: list[str] = (), last_by: Column | None = None) -> DataFrame:
    """New rows replace those of equal keys (null equals null).

    With ``coalesce`` a null keeps the old value in all columns, with ``keep_where_null`` in those named. Repeated keys
    of ``new`` are reduced to the row of the highest ``last_by``; without it, to any one of them.
    """
    new = last_of(new, keys, last_by) if last_by is not None else new.dropDuplicates(keys)
    t, n = target.withColumn("__t", F.lit(1)).alias("t"), new.select(*target.columns).withColumn("__n", F.lit(1)).alias("n")
    both = t.join(n, reduce(lambda x, y: x & y, [F.col(f"t.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]), "full")
    came = F.col("__n").isNotNull()
    pick = lambda c: F.when(came, F.col(f"n.{c}")).otherwise(F.col(f"t.{c}")) if c in keys or not (coalesce or c in keep_where_null) else F.coalesce(f"n.{c}", f"t.{c}")
    return both.select(*[pick(c).alias(c) for c in target.columns])


def insert_missing(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(new.join(target.select(*keys).distinct(), keys, "left_anti").select(*target.columns))


def with_known_key(new: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is known, the others)."""
    return new.join(known.select(key).distinct(), key, "left_semi"), new.join(known.select(key).distinct(), key, "left_anti")


def update_from(target: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``target`` with the columns of its row in ``source`` (one a key); rows without one stay."""
    s = source.select(F.col(key).alias("__k"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = target.join(s, target[key].eqNullSafe(F.col("__k")), "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def append_run(df: DataFrame, path: str, step: str, as_of: str) -> None:
    """Append an audit row (step, at, n_rows) of what ``df`` holds."""
    row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(step).alias("step"), F.lit(as_of).cast("timestamp").alias("at"), "n_rows")
    row.write.mode("append").parquet(path)


