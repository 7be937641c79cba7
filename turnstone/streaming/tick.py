"""The watcher: each batch of new log files is indexed, and the sessions that it changed are held against all that is indexed.

A batch's turns, with what alerts need of them, and its alerts are written to folders of the batch's own number, and a batch reads those
of earlier numbers and its own, so a batch that is run again after a failure gives the same rows. The alerts written so far are all the
state that the waits need.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from turnstone.operators import activity, retrieval
from turnstone.sources import sessions as logs
from turnstone.streaming.watch import WAITS, alert_key

FILES, FRESH_SECONDS = 30, 300
RECALL_LEAST, RECALL_TURNS, RECALL_HITS, ERROR_CHARS = 0.65, 6, 5, 800
PREDICT_TURNS, PREDICT_SHARE = 3, 0.7
PREDICT_AMONG, LOOP_AMONG = 8, 10
PRIMER_LEAST, PRIMER_MOST = 2, 8
#: Tasks that the nearest sessions are looked for in, or twice the cores if those are more: each hands on the best of every query. What is
#: found is a few rows a session, and is kept in as many parts.
SCANS = 16
ALERT = "kind string, session_id string, key string, at timestamp, target string, score double"


def number_of(session_id: Column) -> Column:
    """Sessions as numbers: their own if they are numbers, else a hash."""
    return F.coalesce(session_id.try_cast("bigint"), F.xxhash64(session_id))


def noted(turns: DataFrame, *also: str) -> DataFrame:
    """What is kept of a turn: (session_id, ts, uuid, project_path, text, names, failed, error): its tools, whether a result failed, and its
    error: the last failed result, else the last line that speaks of one."""
    bad = lambda r: r["is_error"]
    failed = F.try_element_at(F.filter("results", bad), F.lit(-1))["content"]
    line = F.try_element_at(F.filter(F.split("text", "\n"), lambda x: F.rlike(F.lower(x), F.lit("error:|traceback|panic"))), F.lit(-1))
    error = F.coalesce(F.left(failed, F.lit(ERROR_CHARS)), F.btrim(line))
    return turns.select("session_id", "ts", "uuid", "project_path", "text", F.col("calls.name").alias("names"), F.exists("results", bad).alias("failed"), error.alias("error"), *also)


def indexed(turns: DataFrame) -> DataFrame:
    """Turns with their session's number (id), their place in it by time, then uuid, and their place from its end, from 1. A session's rows
    lie together in order, so that what is found by session moves none of them again."""
    of = Window.partitionBy("id")
    placed = turns.withColumn("id", number_of(F.col("session_id"))).withColumn("turn_index", F.row_number().over(of.orderBy("ts", "uuid")) - 1)
    return placed.withColumn("back", F.count(F.lit(1)).over(of) - F.col("turn_index")).drop("uuid")


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    return df.repartition(max(SCANS, 2 * df.sparkSession.sparkContext.defaultParallelism), *by)


def next_tools(asks: DataFrame, near: DataFrame, turns: DataFrame, held: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """What the sessions most like each one asked for did after the turn that is most like its own last ones; as activity.predict gives it,
    query_id with kind and id. asks: kind, id, last, horizon, among; near: as retrieval.neighbours gives it."""
    key = lambda id_: F.struct("kind", F.col(id_).alias("id")).alias("query_id")
    pairs = near.withColumnRenamed("id", "session_id").join(asks.select("kind", F.col("id").alias("query_id"), "horizon", "among"), "query_id")
    pairs = held(_dealt(pairs.filter(F.col("rank") <= F.col("among")).select(key("query_id"), "session_id", "score", "horizon"), "query_id"))
    own = turns.select(F.col("id").alias("session_id"), "turn_index", "text", "names")
    last = turns.select("id", "back", "text").join(asks, "id").filter(F.col("back") <= F.col("last"))
    anchors = activity.anchor_words(last.select(key("id"), "text"))
    calls = own.select("session_id", "turn_index", F.explode("names").alias("name"))
    return activity.predict(pairs, activity.pivots_by_query(pairs, own, anchors), calls, F.col("horizon"))


def found(turns: DataFrame, vectors: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame] = logs.embed, held: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(kind, session_id, key, at, target, score): what there is to say of the hot sessions among all. turns: as indexed() gives them, with
    hot (of a file just changed: a session with such a turn is hot) and known (a session with such a turn isn't new).

    vectors: sessions (id, text) -> points (id, vec); embed: rows with a text -> the same with vec; held: keeps what is read several times. Recalls tell of the most similar
    error of another session, predictions of a tool that wasn't used yet, loops of what got others out, primers of a project's past.
    """
    # All that is known of a session, in one pass over the turns.
    error = lambda among: F.max_by("error", F.when(F.col("error").isNotNull() & among, F.col("turn_index")))
    back = F.col("back")
    every = held(turns.groupBy("id").agg(
        F.max("session_id").alias("session_id"), F.count(F.lit(1)).alias("turns"), F.max("ts").alias("at"), F.min_by("text", "turn_index").alias("text"),
        F.max_by("project_path", "turn_index").alias("project"), F.collect_set(F.nullif("project_path", F.lit(""))).alias("projects"),
        F.array_distinct(F.flatten(F.collect_set(F.transform("names", lambda n: F.lower(n))))).alias("used"),
        error(F.lit(True)).alias("error"), error(back <= RECALL_TURNS).alias("late_error"), F.count_if(F.col("failed") & (back <= activity.STUCK_WINDOW)).alias("recent_errors"),
        F.max("hot").alias("hot"), (~F.max("known")).alias("is_new"),
    ))
    hot = every.filter("hot")
    recall = recalled(every.filter("error is not null").select("id", F.col("error").alias("text")), hot.filter("late_error is not null").select("id", F.col("late_error").alias("text")), embed)
    # Nothing new can be predicted for a session that used every tool there is.
    tools = every.select(F.explode("used").alias("tool")).agg(F.countDistinct("tool").alias("tools"))
    long = hot.filter(F.col("turns") >= PREDICT_TURNS).crossJoin(F.broadcast(tools)).filter(F.size(F.array_compact("used")) < F.col("tools"))
    stuck = hot.filter((F.col("turns") >= activity.STUCK_TURNS) & (F.col("recent_errors") >= activity.STUCK_ERRORS))
    ask = lambda df, kind, *numbers: df.select(F.lit(kind).alias("kind"), "id", *[F.lit(n).alias(c) for c, n in zip(("last", "horizon", "among"), numbers)])
    asks = held(_dealt(ask(long, "predict", 3, 3, PREDICT_AMONG).unionAll(ask(stuck, "loop", 4, 4, LOOP_AMONG)), "id"))
    points = held(_dealt(vectors(every.select("id", "text")), "id"))
    wanted = points.join(asks.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("query_id"), "vec")
    near = retrieval.neighbours(points, wanted, max(PREDICT_AMONG, LOOP_AMONG))
    top = next_tools(asks, near, turns, held).filter("rank = 1").select("query_id.kind", F.col("query_id.id").alias("hot"), "name", "freq").join(hot.select(F.col("id").alias("hot"), "used"), "hot")
    likely = top.filter((F.col("kind") == "loop") | (F.col("freq") > PREDICT_SHARE) & ~F.array_contains("used", F.lower("name"))).select("kind", "hot", F.lit("").alias("text"), F.col("name").alias("target"), F.col("freq").alias("score"))
    # Of a project's sessions the new one itself is one; they are counted, not paired.
    of_project = every.select(F.explode("projects").alias("project")).groupBy("project").agg(F.count(F.lit(1)).alias("all"))
    past = hot.filter("is_new").join(of_project, "project").select("id", F.least(F.col("all") - 1, F.lit(PRIMER_MOST)).alias("n")).filter(F.col("n") >= PRIMER_LEAST)
    primer = past.select(F.lit("primer").alias("kind"), F.col("id").alias("hot"), F.lit("").alias("text"), F.col("n").cast("string").alias("target"), F.lit(None).cast("double").alias("score"))
    said = reduce(DataFrame.unionAll, (recall, likely, primer)).join(hot.select(F.col("id").alias("hot"), "session_id", "at"), "hot")
    return said.select("kind", "session_id", alert_key(F.col("kind"), F.col("session_id"), F.col("target"), F.col("text")).alias("key"), "at", "target", "score")


def recalled(errors: DataFrame, asked: DataFrame, embed: Callable[[DataFrame], DataFrame] = logs.embed) -> DataFrame:
    """(kind, hot, text, target, score): for each asked error (id, text) the most similar error of another session, if similar enough; errors: id, text.

    Equal texts are embedded and searched for once: of those with one text, the two smallest ids alone can be the nearest to anyone,
    and the nearest two to a text hold the nearest other one of each session that has it.
    """
    first = errors.groupBy("text").agg(F.min("id").alias("first"))
    second = errors.join(first, "text").filter(F.col("id") != F.col("first")).groupBy("text").agg(F.min("id").alias("second"))
    known = embed(first.join(second, "text", "left").select("text", "first", "second")).select(F.explode(F.array_compact(F.array("first", "second"))).alias("id"), "vec")
    texts = asked.groupBy("text").agg(F.min("id").alias("query_id"))
    hits = retrieval.neighbours(known, embed(texts).select("query_id", "vec"), 2, keep_self=True, at_least=RECALL_LEAST)
    pairs = asked.select(F.col("id").alias("hot"), "text").join(texts, "text").join(hits.select("query_id", "id", "score"), "query_id").filter(F.col("id") != F.col("hot"))
    best = pairs.groupBy("hot").agg(F.first("text").alias("text"), F.min(F.struct((-F.col("score")).alias("less"), "id")).alias("b"))
    return best.select(F.lit("recall").alias("kind"), "hot", "text", F.col("b.id").cast("string").alias("target"), (-F.col("b.less")).alias("score"))


def recall_queue(errors: DataFrame, index: DataFrame, embed: Callable[[DataFrame], DataFrame] = logs.embed, first: int = 8, most: int = 4) -> DataFrame:
    """(place, session_id, error_text, match_id, score): the first errors by place, each text of a session once by its first 80 characters,
    with the most similar error of another session; those that have none are left out, and what comes after `most` of them.

    errors: place, id, session_id, error_text; index: id and the text of every session's error.
    """
    lead = errors.orderBy("place", "session_id").limit(first)
    once = lead.groupBy("session_id", F.left("error_text", F.lit(80)).alias("_head")).agg(F.min(F.struct("place", "id", "error_text")).alias("e")).select("session_id", "e.*")
    asked = embed(once.withColumn("text", F.col("error_text")))
    hits = retrieval.neighbours(embed(index.select("id", "text")).select("id", "vec"), asked.select(F.col("id").alias("query_id"), "vec"), RECALL_HITS, at_least=RECALL_LEAST).filter("rank = 1")
    return once.join(hits.select(F.col("query_id").alias("id"), F.col("id").alias("match_id"), "score"), "id").select("place", "session_id", "error_text", "match_id", "score").orderBy("place", "session_id").limit(most)


def after_waits(alerts: DataFrame, sent: DataFrame, waits: dict[str, int] = WAITS) -> DataFrame:
    """The alerts (kind, key, at) whose kind and key have waited long enough since the last one sent."""
    wait = F.coalesce(F.create_map(*[F.lit(x) for pair in waits.items() for x in pair])[F.col("kind")], F.lit(0)).cast("bigint")
    last = sent.groupBy("kind", "key").agg(F.max("at").alias("before"))
    return alerts.join(last, ["kind", "key"], "left").filter(F.col("before").isNull() | (F.unix_micros("at") - F.unix_micros("before") >= wait * 1_000_000)).drop("before")


def _stored(spark: SparkSession, path: str, schema: str, upto: int) -> DataFrame:
    """The rows of batches up to that number; none where nothing is stored."""
    try:
        return spark.read.schema(f"{schema}, batch int").parquet(path).filter(F.col("batch") <= upto)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch int")


def on_batch(store: str, vectors: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame] = logs.embed, fresh: int = FRESH_SECONDS, clock: Column | None = None) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch over lines (line, changed). Sessions are hot if a file of theirs was changed less than `fresh` seconds
    before the clock; without one, before the batch's newest file."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = noted(logs.spoken_turns(batch, "changed"), "changed")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
        new.write.mode("overwrite").parquet(f"{store}/turns/batch={number}")
        now = clock if clock is not None else F.lit(batch.agg(F.max("changed")).first()[0]).cast("timestamp")
        is_hot = (F.col("batch") == number) & (F.unix_micros("changed") >= F.unix_micros(now) - fresh * 1_000_000)
        turns = _stored(spark, f"{store}/turns", schema, number).withColumn("hot", is_hot).withColumn("known", F.col("batch") < number).drop("changed", "batch")
        sent = _stored(spark, f"{store}/alerts", ALERT, number - 1)
        kept: list[DataFrame] = []

        def held(df: DataFrame) -> DataFrame:
            kept.append(df.persist())
            return kept[-1]

        said = found(held(indexed(turns)), vectors, embed, held)
        after_waits(said, sent).select("kind", "session_id", "key", "at", "target", "score").write.mode("overwrite").parquet(f"{store}/alerts/batch={number}")
        for df in kept:
            df.unpersist()

    return run


def watch(spark: SparkSession, root: str, store: str, vectors: Callable[[DataFrame], DataFrame], files: int = FILES, **options) -> None:
    """Works off the log files under root that weren't seen yet, so many in a batch, the oldest first."""
    stream = spark.readStream.format("text").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).load(root)
    lines = stream.select(F.col("value").alias("line"), F.col("_metadata.file_modification_time").alias("changed"))
    lines.writeStream.foreachBatch(on_batch(store, vectors, **options)).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def alerts(spark: SparkSession, store: str) -> DataFrame:
    """(kind, session_id, key, at, target, score, batch) of all batches."""
    return _stored(spark, f"{store}/alerts", ALERT, 2**31 - 1)
