"""Structured Streaming forms of the registry's state, quotas and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.queues import retry_state
from ..operators.tables import last_of, upsert


def daily_quota(requests: DataFrame, limits: dict[str, int], *, late: str = "1 day") -> DataFrame:
    """(user, tier, day, n, over): requests of a key and day, with a watermark; over: more than its tier's daily limit (100 without one)."""
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("tier")), F.lit(100))
    out = requests.withWatermark("ts", late).groupBy("user", "tier", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user", "tier", F.col("w.start").cast("date").alias("day"), "n", (F.col("n") > limit).alias("over"))


def rolling_counts(events: DataFrame, *, span: str = "7 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    """(status, until, n): counts over a sliding span."""
    out = events.withWatermark("ts", late).groupBy("status", F.window("ts", span, step).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("status", F.col("w.end").alias("until"), "n")


def changed(pages: DataFrame, *, late: str = "30 days") -> DataFrame:
    """The first row of each (url, content hash) within the watermark: contents that were not there before. state.content_changes also gives returns to an earlier content."""
    return pages.withColumn("hash", F.sha2("content", 256)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["url", "hash"])


def keep_registry(attempts: DataFrame, path: str) -> DataStreamWriter:
    """A writer that keeps a registry table (url, status, retry_after, retry_count) by upserts of each batch of fetch attempts.

    A small registry as a plain table; state.registry_states keeps one of any size in the state store, with timers.
    ``attempts``: url, http, retry_count, at. Versions of the table alternate between two folders named by the
    batch's parity, so a batch that is run again reads what it read before and writes the same.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ok = F.col("http").between(200, 399)
        status, after = retry_state(F.lit("active"), F.col("http"), F.col("retry_count"), F.col("at"))
        new = last_of(batch, ["url"], F.col("at"))
        new = new.select("url", F.when(ok, "active").otherwise(status).alias("status"), F.when(~F.coalesce(ok, F.lit(False)), after).alias("retry_after"), F.when(ok, 0).otherwise(F.col("retry_count") + 1).alias("retry_count"))
        if number:
            new = upsert(spark.read.parquet(f"{path}/{(number - 1) % 2}"), new, ["url"])
        new.write.mode("overwrite").parquet(f"{path}/{number % 2}")

    return attempts.writeStream.foreachBatch(apply)
