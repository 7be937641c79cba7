"""Queries that run a stream over the events to its end: name -> (query, SQL that gives the same rows, or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnstone.plans.adapters import table
from turnstone.sources.shared import new_folder
from turnstone.streaming import watch


def _run(spark, d: str, build, mode: str = "append") -> DataFrame:
    """The output of a replay of the events in time order, read back."""
    e = table(spark, d, "events")
    named = e.select(F.col("user_id").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("name"), (F.col("event_type") == "error").alias("is_error"))
    return watch.replay(named, build, new_folder(spark, "stream"), mode)


def stream_debounce(spark, d):
    """The errors of each session that come at least 20 minutes after the last one let through."""
    return _run(spark, d, lambda e: watch.debounced(e.filter("is_error"), "session_id", watch.DEBOUNCE_SECONDS)).select("session_id", F.col("ts").cast("string").alias("ts"))


def stream_stuck_alerts(spark, d):
    return _run(spark, d, watch.stuck_alerts).select("session_id", F.col("ts").cast("string").alias("ts"), "errors")


def stream_latest_error(spark, d):
    """The stream's batches are folded: the newest of what each batch had."""
    folder = new_folder(spark, "latest")
    static = table(spark, d, "events")
    stream = watch.read_events(spark, f"{d.rstrip('/')}/{{events}}.parquet", static.schema)
    named = stream.select(F.col("user_id").alias("session_id"), "event_id", "ts", (F.col("event_type") == "error").alias("is_error"))

    def keep(batch: DataFrame, number: int) -> None:
        watch.latest_errors(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    named.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    every = spark.read.parquet(folder)
    return every.groupBy("session_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


_MINUTES = watch.DEBOUNCE_SECONDS // 60


def _greedy(ready: str, extra: str = "") -> str:
    """Each key's rows of `ready` (session_id, ts, event_id) that come long enough after the last one taken."""
    return f"a AS (SELECT session_id, min(ts) AS ts FROM {ready} GROUP BY ALL UNION ALL SELECT * FROM (SELECT a.session_id, min(r.ts) AS ts FROM a JOIN {ready} r ON r.session_id = a.session_id AND r.ts >= a.ts + INTERVAL {_MINUTES} MINUTES GROUP BY ALL))"


_TS = "rtrim(rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.')"
_READY = f"c AS (SELECT user_id AS session_id, ts, event_id, event_type = 'error' AS bad, row_number() OVER w AS n, sum((event_type = 'error')::INT) OVER (w ROWS 9 PRECEDING)::INT AS errors FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT * FROM c WHERE bad AND n >= {watch.LEAST_TURNS} AND errors >= {watch.LEAST_ERRORS})"
QUERIES: dict[str, tuple] = {
    "stream_debounce": (stream_debounce, f"WITH RECURSIVE e AS (SELECT user_id AS session_id, ts, event_id FROM events WHERE event_type = 'error'), {_greedy('e')} SELECT session_id, {_TS} AS ts FROM a"),
    "stream_latest_error": (stream_latest_error, "SELECT user_id AS session_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events WHERE event_type = 'error' GROUP BY ALL"),
    "stream_stuck_alerts": (stream_stuck_alerts, f"WITH RECURSIVE {_READY}, {_greedy('r')} SELECT a.session_id, {_TS.replace('(ts,', '(a.ts,')} AS ts, arg_min(r.errors, r.event_id) AS errors FROM a JOIN r ON r.session_id = a.session_id AND r.ts = a.ts GROUP BY a.session_id, a.ts"),
}
