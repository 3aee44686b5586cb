"""Streams over files, a batch a file, until all are read."""

import datetime as dt

from pyspark.sql import functions as F

from penstock.streaming import registry as S

DAY = dt.datetime(2024, 1, 1)


def stream(spark, folder, schema, batches):
    folder.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def run(writer, tmp_path, name):
    query = writer.option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_quota_and_counts(spark, tmp_path):
    schema = "user string, tier string, status string, ts timestamp"
    rows = [("a", "free", "ok", DAY + dt.timedelta(hours=h)) for h in range(5)] + [("b", "paid", "bad", DAY), ("a", "free", "ok", DAY + dt.timedelta(days=1))]
    df = stream(spark, tmp_path / "in", schema, [rows])
    run(S.daily_quota(df, {"free": 3, "paid": 9}).writeStream.format("memory").queryName("quota").outputMode("complete"), tmp_path, "quota")
    assert {(r["user"], r["day"].day, r["n"], r["over"]) for r in spark.table("quota").collect()} == {("a", 1, 5, True), ("b", 1, 1, False), ("a", 2, 1, False)}
    run(S.rolling_counts(df).writeStream.format("memory").queryName("rolling").outputMode("complete"), tmp_path, "rolling")
    assert spark.table("rolling").filter("status = 'ok'").agg(F.max("n")).first()[0] == 6


def test_new_content_comes_once(spark, tmp_path):
    rows = [[("u", "x", DAY)], [("u", "x", DAY + dt.timedelta(hours=1))], [("u", "y", DAY + dt.timedelta(hours=2))]]
    df = stream(spark, tmp_path / "in", "url string, content string, ts timestamp", rows)
    run(S.changed(df).writeStream.format("memory").queryName("changed"), tmp_path, "changed")
    assert sorted(r["content"] for r in spark.table("changed").collect()) == ["x", "y"]


def test_registry_is_kept(spark, tmp_path):
    hour = dt.timedelta(hours=1)
    batches = [[("u", 403, 0, DAY), ("v", 200, 3, DAY), ("w", 404, 0, DAY)], [("u", 403, 1, DAY + hour), ("u", 503, 2, DAY + 2 * hour)]]
    df = stream(spark, tmp_path / "in", "url string, http int, retry_count int, at timestamp", batches)
    run(S.keep_registry(df, f"{tmp_path}/registry"), tmp_path, "registry")
    got = {r["url"]: (r["status"], r["retry_after"], r["retry_count"]) for r in spark.read.parquet(f"{tmp_path}/registry/1").collect()}
    assert got == {"u": ("pending_retry", DAY + 8 * hour, 3), "v": ("active", None, 0), "w": ("dead", None, 1)}


def test_states_with_late_attempts_and_a_restart(spark, tmp_path):
    from penstock.streaming import state

    hour, schema = dt.timedelta(hours=1), "url string, http int, at timestamp"
    first = [[("u", 403, DAY), ("v", 503, DAY + hour), ("w", 404, DAY), (None, 200, DAY)], [("u", 403, DAY + 60 * hour), ("u", 403, DAY - hour), ("v", 200, DAY)]]
    second = [[("x", 200, DAY + 400 * hour)], [("u", 200, DAY + 401 * hour), ("u", None, DAY + 402 * hour)], [("x", 200, DAY + 900 * hour)]]
    df = stream(spark, tmp_path / "in", schema, first)
    start = lambda: run(state.registry_states(df).writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("append").parquet(f"{tmp_path}/out")), tmp_path, "states")
    start()
    got = lambda: sorted((r["url"], r["at"], r["status"], r["retry_count"], r["retry_after"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # v's late success changes nothing; u's second refusal doubles the pause, its late one doesn't count
    assert got() == [("u", DAY, "pending_retry", 1, DAY + 48 * hour), ("u", DAY + 60 * hour, "pending_retry", 2, DAY + 156 * hour), ("v", DAY + hour, "due", 1, DAY + 7 * hour), ("v", DAY + hour, "pending_retry", 1, DAY + 7 * hour), ("w", DAY, "dead", 1, None)]
    for k, rows in enumerate(second):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/c{k}")
    start()
    after = [x for x in got() if x[0] != "w" and x[1] >= DAY + 60 * hour]
    # u is fetched before its time shows as due; the count goes on from what was kept before the restart
    assert [x for x in after if x[0] == "u"] == [("u", DAY + 60 * hour, "pending_retry", 2, DAY + 156 * hour), ("u", DAY + 402 * hour, "due", 1, DAY + 426 * hour), ("u", DAY + 402 * hour, "pending_retry", 1, DAY + 426 * hour)]


def test_returning_content_is_a_change(spark, tmp_path):
    from penstock.streaming import state

    at = lambda k: DAY + dt.timedelta(hours=k)
    df = stream(spark, tmp_path / "in", "url string, content string, ts timestamp", [[("u", "A", at(0)), ("u", "A", at(1)), ("v", "A", at(5))], [("u", "B", at(2)), ("v", "C", at(4))], [("u", "A", at(3)), (None, "A", at(1)), ("u", None, at(9))]])
    run(state.content_changes(df).writeStream.format("memory").queryName("returning").outputMode("append"), tmp_path, "returning")
    rows = sorted((r["url"], r["ts"], r["previous"] is None) for r in spark.table("returning").collect())
    assert rows == [("u", at(0), True), ("u", at(2), False), ("u", at(3), False), ("v", at(5), True)]


def test_pauses_between_tries():
    from penstock.streaming.state import after_fetch

    days = [after_fetch(403, n, DAY)[1] and (after_fetch(403, n, DAY)[1] - DAY).days for n in range(6)]
    assert days == [2, 4, 8, 16, 30, None] and after_fetch(403, 5, DAY)[0] == "dead"
    assert after_fetch(404, 0, DAY) == ("dead", None, 1) and after_fetch(500, 2, DAY)[1] == DAY + dt.timedelta(hours=6) and after_fetch(None, 0, DAY)[1] == after_fetch(429, 0, DAY)[1] == DAY + dt.timedelta(days=1) and after_fetch(304, 4, DAY) == ("active", None, 0)
