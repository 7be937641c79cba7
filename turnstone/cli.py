"""Command line over session logs: each command is a Spark job that prints its rows or a report."""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnstone.functions import text as t
from turnstone.operators import activity, extract, graph, memory, retrieval, store
from turnstone.session import session, ship
from turnstone.sources import sessions as logs


def points(got: logs.Sessions) -> DataFrame:
    """One point a session: a numeric id, its content's vector, and what filters read."""
    said = got.turns.filter("trim(text) <> ''").groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "text"))), lambda s: s["text"]), "\n").alias("text"))
    errors = got.results.groupBy("session_id").agg(F.max("is_error").alias("has_errors"))
    base = got.sessions.join(said, "session_id").join(errors, "session_id", "left")
    base = base.select(F.xxhash64("session_id").alias("id"), "session_id", F.col("project_name").alias("project"), F.coalesce("has_errors", F.lit(False)).alias("has_errors"), F.unix_timestamp("start_ts").alias("start_ts"), F.left(t.redact(F.col("text")), F.lit(6000)).alias("text"))
    return logs.embed(base)


def ask(spark: SparkSession, text: str) -> DataFrame:
    return logs.embed(spark.createDataFrame([(-1, text)], "query_id bigint, text string"))


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame | str:
    got = logs.read_all(spark, dict(r.split("=", 1) for r in args.root))
    if args.command == "scan":
        return extract.summaries(got.sessions, got.calls, got.results, args.limit)
    if args.command in ("search", "recall"):
        pool = points(got)
        pool = pool.filter("has_errors") if args.command == "recall" else pool
        return retrieval.neighbours(pool, ask(spark, args.text), args.limit, at_least=0.65 if args.command == "recall" else None).join(pool.select("id", "session_id", "project"), "id").orderBy("rank").select("rank", "session_id", "project", "score")
    if args.command == "extracts":
        return extract.session_extracts(got.sessions, got.turns, got.calls, got.results)
    if args.command == "enrich":
        return extract.enrichment(got.sessions, got.turns, got.calls, got.results)
    if args.command == "turn":
        session, _, index = args.text.partition("#")
        return store.turn_at(got.turns, session, int(index or 0))
    if args.command == "reindex":
        store.write_replacing(points(got._replace(sessions=store.of_project(got.sessions, args.text))), f"{args.folder}/points", "session_id")
        return "written"
    if args.command == "topology":
        own = graph.sample(points(got), args.limit)
        return graph.insights(own, got.calls.join(own.select("session_id", "id"), "session_id").select(F.col("id").alias("session_id"), "name", "input_json"), graph.spanning_forest(graph.pairs(own, 5)))
    if args.command == "memory":
        return memory.primer(got.turns, got.calls, got.results, memory.sources(got.sessions, args.text, None, None, args.limit), args.text)
    if args.command == "wrapped":
        sizes = got.turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"))
        errors = got.results.groupBy("session_id").agg(F.max("is_error").alias("has_errors"))
        intents = extract.enrichment(got.sessions, got.turns, got.calls, got.results).select("session_id", "intent", "outcome", "arc")
        s = got.sessions.join(sizes, "session_id").join(errors, "session_id", "left").join(intents, "session_id", "left").select(F.col("session_id"), "start_ts", F.col("source_agent").alias("agent"), F.col("project_name").alias("project"), F.coalesce("intent", F.lit("mixed")).alias("intent"), "outcome", "arc", "turns", F.coalesce("has_errors", F.lit(False)).alias("has_errors"))
        as_of = args.as_of or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        return memory.digest(s, got.turns, got.calls, F.lit(as_of).cast("timestamp"), args.days)
    store.export_snapshot(points(got), store.check_path(args.text, args.folder))
    return "written"


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="turnstone")
    p.add_argument("command", choices=["scan", "search", "recall", "extracts", "enrich", "turn", "topology", "memory", "wrapped", "reindex", "snapshot"])
    p.add_argument("text", nargs="?", default="", help="query, project, session#turn, project path or snapshot name")
    p.add_argument("--root", action="append", required=True, metavar="AGENT=FOLDER", help=f"one of {', '.join(logs.AGENTS)} and a folder; may be repeated")
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--days", type=int, default=30)
    p.add_argument("--as-of")
    p.add_argument("--folder", default="", help="where snapshots and points go; a folder that the driver and all executors share")
    args = p.parse_args(argv)
    if args.command in ("reindex", "snapshot") and not args.folder:
        p.error(f"{args.command} needs --folder")
    spark = session()
    ship(spark)
    out = run(spark, args)
    if isinstance(out, DataFrame):
        out.show(args.limit if args.command == "scan" else 200, False)
    else:
        print(out)


if __name__ == "__main__":
    main()
