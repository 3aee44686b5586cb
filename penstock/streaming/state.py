"""Streams with a state per URL: the registry of fetches with its retry timers, and changes of content.

Both keep one small value a URL in the state store; Spark deals URLs over tasks and restores the state after a loss or a
restart from the query's checkpoint.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Most failures by refusal before a URL is dead, most days between tries, hours after a fault of the server, days after other faults.
REFUSALS, MOST_DAYS, FAULT_HOURS, OTHER_DAYS = 5, 30, 6, 1
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def after_fetch(http: int | None, failures: int, at: dt.datetime) -> tuple[str, dt.datetime | None, int]:
    """(status, when to try again, failures) after a fetch; ``failures`` are those so far. Success begins anew."""
    if http is not None and 200 <= http < 400:
        return "active", None, 0
    failures += 1
    if http == 404 or http == 403 and failures > REFUSALS:
        return "dead", None, failures
    if http == 403:
        return "pending_retry", at + dt.timedelta(days=min(2**failures, MOST_DAYS)), failures
    return "pending_retry", at + (dt.timedelta(hours=FAULT_HOURS) if http is not None and http >= 500 else dt.timedelta(days=OTHER_DAYS)), failures


def _whole(x) -> int | None:
    return None if pd.isna(x) else int(x)


class _Registry(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "status string, retry_after timestamp, retry_count int, at timestamp")

    def _row(self, url: str, status: str, after, failures: int, at) -> pd.DataFrame:
        return pd.DataFrame({"url": [url], "status": [status], "retry_after": pd.Series([after], dtype="datetime64[us]"), "retry_count": pd.Series([failures], dtype="int32"), "at": pd.Series([at], dtype="datetime64[us]")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, after, failures, at = self.kept.get() if self.kept.exists() else (None, None, 0, None)
        before = at
        for a in sorted((t for part in rows for t in part[["at", "http"]].itertuples(index=False)), key=lambda t: (t.at, _whole(t.http) or 0)):
            if at is None or a.at.to_pydatetime() > at:  # an attempt that comes late says nothing about now
                at = a.at.to_pydatetime()
                status, after, failures = after_fetch(_whole(a.http), failures, at)
        if at == before:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if after is not None:
            self.handle.registerTimer(int(after.replace(tzinfo=dt.timezone.utc).timestamp() * 1000))
        self.kept.update((status, after, failures, at))
        yield self._row(key[0], status, after, failures, at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, after, failures, at = self.kept.get()
        self.kept.update(("due", after, failures, at))
        yield self._row(key[0], "due", after, failures, at)

    def close(self) -> None:
        pass


class _Changes(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string, ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had, at = self.last.get() if self.last.exists() else (None, None)
        out = []
        for r in sorted((t for part in rows for t in part[["ts", "hash"]].itertuples(index=False)), key=lambda t: (t.ts, t.hash)):
            if at is not None and r.ts.to_pydatetime() < at:
                continue
            if r.hash != had:
                out.append((key[0], r.ts, r.hash, had))
            had, at = r.hash, r.ts.to_pydatetime()
        if at is not None:
            self.last.update((had, at))
        if out:
            made = pd.DataFrame(out, columns=["url", "ts", "hash", "previous"])
            made["ts"] = made["ts"].astype("datetime64[us]")
            yield made

    def close(self) -> None:
        pass


def _rocks(spark: SparkSession) -> None:
    """States of several variables and timers need the store on disk; a session that has chosen it is left alone."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def registry_states(attempts: DataFrame, *, late: str = "1 day") -> DataFrame:
    """(url, status, retry_after, retry_count, at): the state of each URL after its attempts (url, http, at), an update a batch.

    Failures are counted in the state, not taken from the attempts. Attempts of one batch are taken in order of time;
    one that is not later than the last that counted changes nothing. When the watermark passes a URL's retry_after, it
    comes out as ``due``. A null status code is a fault of another kind; rows with a null URL or time are left out.
    """
    _rocks(attempts.sparkSession)
    rows = attempts.filter("url is not null and at is not null").select("url", F.col("http").cast("int").alias("http"), "at").withWatermark("at", late)
    return rows.groupBy("url").transformWithStateInPandas(_Registry(), "url string, status string, retry_after timestamp, retry_count int, at timestamp", "Update", "EventTime")


def content_changes(pages: DataFrame) -> DataFrame:
    """(url, ts, hash, previous): a row whenever the content of a URL (url, content, ts) is another than its last one, also if it was there before.

    previous is null for the first content. Rows of a batch are taken in order of time; older ones than the last are left
    out, as are null URLs, times and contents.
    """
    _rocks(pages.sparkSession)
    rows = pages.filter("url is not null and ts is not null and content is not null").select("url", "ts", F.sha2("content", 256).alias("hash"))
    return rows.groupBy("url").transformWithStateInPandas(_Changes(), "url string, ts timestamp, hash string, previous string", "Append", "None")
