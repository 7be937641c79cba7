"""Alerts over a stream of events, by event time with a watermark, so that a replay gives the same alerts.

events: session_id, event_id, ts, name, is_error. Rows later than the watermark are dropped by Spark, and what is kept by session
takes rows in the order in which batches bring them; replay() brings a table in time order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WATERMARK = "1 hour"
#: Seconds between two alerts of one kind for one key: loops, predictions, recalled errors, primers.
DEBOUNCE_SECONDS = 20 * 60
PREDICT_SECONDS, RECALL_SECONDS, PRIMER_SECONDS, REINDEX_SECONDS = 30 * 60, 60 * 60, 24 * 60 * 60, 90
#: What each kind of alert waits for after the last one with its key.
WAITS = {"loop": DEBOUNCE_SECONDS, "predict": PREDICT_SECONDS, "recall": RECALL_SECONDS, "primer": PRIMER_SECONDS, "reindex": REINDEX_SECONDS}
#: What is known of a session is forgotten after so long without an event.
IDLE_MS = 14 * 24 * 60 * 60 * 1000
LAST, LEAST_TURNS, LEAST_ERRORS = 10, 12, 3
#: Groups that keys with a state are dealt to.
BUCKETS = 2_048
SLICES = 4


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 30) -> DataFrame:
    """A folder of event files as a stream, the oldest files first. A file is read once, so logs must grow by new files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def replay(events: DataFrame, build: Callable[[DataFrame], DataFrame], folder: str, mode: str = "append", slices: int = SLICES) -> DataFrame:
    """What build makes of the table as a stream in time order: a slice of time is written, the stream works it off, then the next.

    However the table's own files lie, and however many there are, no batch has a row that comes before one of an earlier batch.
    """
    spark = events.sparkSession
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(at), F.max(at)).first()
    cuts = [low + (high - low + 1) * i // slices for i in range(slices + 1)] if low is not None else [0, 1]
    for a, b in zip(cuts, cuts[1:]):
        events.filter((at >= a) & (at < b)).write.mode("append").parquet(f"{folder}/events")
        stream = build(read_events(spark, f"{folder}/events", events.schema, 1 << 30))
        run_once(stream, f"{folder}/out", f"{folder}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def keyed(events: DataFrame, key: str, fields: list[str], step: Callable, out: str, state: str) -> DataFrame:
    """events by key in time order through step(rows, state) -> (rows, state), with the state kept between batches and forgotten after
    IDLE_MS without an event of the key. rows: of the key's events, (ts, event_id, *fields); of what is found, `out` without the key.

    Keys are dealt to BUCKETS groups, each of which has the states of its keys: a call for each key costs far more than its few rows.
    """
    name, kind = F.col(key), events.schema[key].dataType.simpleString()
    stored = [f.split(" ", 1) for f in state.split(", ")]
    schema = ", ".join(["keys array<string>", "seen array<bigint>", *(f"{f} array<{t}>" for f, t in stored)])
    columns = [f.split(" ")[0] for f in out.split(", ")]

    def run(own: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        known = {k: (seen, s) for k, seen, *s in zip(*map(list, kept.get))} if kept.exists else {}
        found: list[list] = [[] for _ in columns]
        new: dict[str | None, list[tuple]] = {}
        timed_out = kept.hasTimedOut
        if not timed_out:
            rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
            for k, *row in zip(*(rows[c].tolist() for c in ["_key", "ts", "event_id", *fields])):
                new.setdefault(None if pd.isna(k) else k, []).append(tuple(row))
        for k, mine in new.items():
            got, now = step(mine, tuple(known[k][1]) if k in known else None)
            known[k] = (int(mine[-1][0].timestamp() * 1000), now)
            for x in got:
                for column, value in zip(found, (k, *x)):
                    column.append(value)
        mark = kept.getCurrentWatermarkMs()
        known = {k: v for k, v in known.items() if k in new or v[0] + IDLE_MS > mark}
        if known:
            kept.update(([*known], [v[0] for v in known.values()], *([v[1][i] for v in known.values()] for i in range(len(stored)))))
            kept.setTimeoutTimestamp(max(min(v[0] for v in known.values()) + IDLE_MS, mark + 1))
        elif kept.exists:
            kept.remove()
        if not timed_out:
            yield pd.DataFrame(dict(zip(columns, found)))

    dealt = events.select(F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int").alias("_bucket"), name.cast("string").alias("_key"), "ts", "event_id", *fields)
    text = ", ".join(["_key string", *out.split(", ")[1:]])
    columns[0] = "_key"
    got = dealt.withWatermark("ts", WATERMARK).groupBy("_bucket").applyInPandasWithState(run, text, schema, "append", GroupStateTimeout.EventTimeTimeout)
    return got.select(F.col("_key").cast(kind).alias(key), *columns[1:])


def _fire(times: list[float], ready: list[bool], since: float, wait: float) -> list[int]:
    """The places of what fires: each ready one at least `wait` after the last that fired."""
    out = []
    for i, (t, ok) in enumerate(zip(times, ready)):
        if ok and t - since >= wait:
            out.append(i)
            since = t
    return out


def _seconds(ts: pd.Series) -> list[float]:
    return [x.timestamp() for x in ts]


def stuck_alerts(events: DataFrame, debounce: int = DEBOUNCE_SECONDS, last: int = LAST, turns: int = LEAST_TURNS, errors: int = LEAST_ERRORS) -> DataFrame:
    """(session_id, ts, errors): an error in a session of enough events, with enough errors among the last ones; at most one alert
    within the debounce time. The state of a session is its last flags, its count and the time of its last alert."""

    def step(rows: list[tuple], state: tuple | None):
        flags, n, fired = state or ("", 0, float("-inf"))
        own = [int(c) for c in flags] + [int(bool(bad)) for _, _, bad in rows]
        among = [sum(own[max(0, i + 1 - last) : i + 1]) for i in range(len(flags), len(own))]
        times = [ts.timestamp() for ts, _, _ in rows]
        ready = [bool(bad) and n + i + 1 >= turns and a >= errors for i, ((_, _, bad), a) in enumerate(zip(rows, among))]
        at = _fire(times, ready, fired, debounce)
        return [(rows[i][0], among[i]) for i in at], ("".join(map(str, own[-last:])), n + len(rows), times[at[-1]] if at else fired)

    return keyed(events, "session_id", ["is_error"], step, "session_id bigint, ts timestamp, errors int", "flags string, n int, fired double")


def debounced(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """(key, ts, event_id): the events of each key, each at least so many seconds after the last one that was let through."""

    def step(rows: list[tuple], state: tuple | None):
        times = [ts.timestamp() for ts, _ in rows]
        at = _fire(times, [True] * len(times), state[0] if state else float("-inf"), seconds)
        return [rows[i] for i in at], (times[at[-1]] if at else state[0],)

    kind = events.schema[key].dataType.simpleString()
    return keyed(events, key, [], step, f"{key} {kind}, ts timestamp, event_id bigint", "fired double")


def waited(alerts: DataFrame, waits: dict[str, int] = WAITS) -> DataFrame:
    """The alerts (kind, key, ts, event_id) of a stream that come as long after the last one let through of their kind and key as the
    kind waits; kinds without a wait all pass. A key's state is a time, and is forgotten as soon as the wait is over."""

    def run(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kind, key = own
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        times, wait = _seconds(rows["ts"]), waits.get(kind, 0)
        at = _fire(times, [True] * len(times), state.get[0] if state.exists else float("-inf"), wait)
        if at:
            state.update((times[at[-1]],))
        if state.exists:
            state.setTimeoutTimestamp(max(int((state.get[0] + wait) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"kind": [kind] * len(at), "key": [key] * len(at), "ts": rows["ts"].iloc[at].tolist(), "event_id": rows["event_id"].iloc[at].tolist()})

    keyed_rows = alerts.select("kind", "key", "ts", "event_id").withWatermark("ts", WATERMARK).groupBy("kind", "key")
    return keyed_rows.applyInPandasWithState(run, "kind string, key string, ts timestamp, event_id bigint", "fired double", "append", GroupStateTimeout.EventTimeTimeout)


def alert_key(kind: Column, session_id: Column, tool: Column, content: Column) -> Column:
    """What an alert is debounced by: its session, and the tool of a prediction or the first characters of a recalled error."""
    session = session_id.cast("string")
    return F.when(kind == "predict", F.concat_ws("|", session, F.lower(tool))).when(kind == "recall", recall_key(session_id, content)).otherwise(session)


def recall_key(session_id, content):
    """What recalled errors are debounced by: the session and the first 120 characters of the error."""
    return F.concat_ws("|", session_id.cast("string"), F.left(content, F.lit(120)))


def predict_alerts(predictions: DataFrame, used: DataFrame, turns: DataFrame, least: float = 0.7, least_turns: int = 3) -> DataFrame:
    """(query_id, name, freq): the first prediction of a session of enough turns, if it is frequent enough and its tool, whatever its
    case, wasn't used yet. predictions: as activity.predict gives them; used: session_id, name; turns: session_id, turns."""
    long = turns.filter(F.col("turns") >= least_turns).select(F.col("session_id").alias("query_id"))
    top = predictions.filter((F.col("rank") == 1) & (F.col("freq") > least)).join(long, "query_id", "left_semi")
    own = used.select(F.col("session_id").alias("query_id"), F.lower("name").alias("_tool")).distinct()
    return top.join(own, (top["query_id"] == own["query_id"]) & (F.lower(top["name"]) == own["_tool"]), "left_anti").select("query_id", "name", "freq")


def primer_alerts(sources: DataFrame, least: int = 2) -> DataFrame:
    """(query_id, sources): new sessions for which at least two past ones tell something. sources: query_id, id."""
    return sources.groupBy("query_id").agg(F.countDistinct("id").alias("sources")).filter(F.col("sources") >= least)


def loop_alerts(stuck: DataFrame, predictions: DataFrame) -> DataFrame:
    """Stuck sessions with what like sessions did next: (session_id, recent_errors, next_tool, freq), null where nothing is known."""
    top = predictions.filter("rank = 1").select(F.col("query_id").alias("session_id"), F.col("name").alias("next_tool"), "freq")
    return stuck.join(top, "session_id", "left").select("session_id", "recent_errors", "next_tool", "freq")


def latest_errors(events: DataFrame) -> DataFrame:
    """(session_id, ts, event_id): each session's newest error so far; for update or complete output."""
    return events.filter("is_error").groupBy("session_id").agg(F.max("ts").alias("ts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def error_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Errors by tumbling or sliding window."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", WATERMARK).filter("is_error").groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def error_bursts(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a session's errors with less than the gap between them."""
    return events.withWatermark("ts", WATERMARK).filter("is_error").groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("session_id", F.col("w.start").alias("start"), "n")


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Everything there is now, to Parquet files."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def recall_on_batch(index: DataFrame, sink, at_least: float = 0.65, k: int = 5):
    """A function for foreachBatch: the batch's error vectors (query_id, vec) against the index's error sessions, other sessions only."""
    from turnstone.operators.retrieval import neighbours

    def on_batch(batch: DataFrame, number: int) -> None:
        sink(neighbours(index.filter("has_errors"), batch, k, at_least=at_least), number)

    return on_batch
