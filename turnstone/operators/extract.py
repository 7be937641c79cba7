"""What is told of a session: its five texts for indexing, and its enrichment as one table.

sessions, turns, calls, results: as the readers of logs give them. A session's rows are gathered in one list each, as its texts are
one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnstone.functions import text as t
from turnstone.operators import enrich

TEXT_CAP, PIECE_CAP = 6_000, 800


def _joined(rows: DataFrame, order: list[str], value: Column, separator: str, name: str) -> DataFrame:
    """(session_id, name): the values that aren't null, in order."""
    kept = rows.withColumn("_v", value).filter("_v is not null")
    return kept.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_v"))), lambda s: s["_v"]), separator).alias(name))


def content(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    line = F.when(F.col("text") != "", F.concat(F.when(F.col("role") == "user", "U: ").otherwise("A: "), "text"))
    said = _joined(turns.filter("role in ('user', 'assistant')"), ["turn_index"], line, "\n", "said")
    head = F.when(F.col("title").isNotNull(), F.concat(F.lit("title: "), "title", F.lit("\n"))).otherwise("")
    whole = F.concat(head, F.coalesce(F.concat("said", F.lit("\n")), F.lit("")))
    return sessions.join(said, "session_id", "left").select("session_id", F.coalesce(F.nullif(whole, F.lit("")), "project_name", F.lit("session")).alias("content"))


def tool(calls: DataFrame) -> DataFrame:
    return _joined(calls, ["turn_index", "call_seq"], F.concat("name", F.lit(": "), t.tool_snippet(F.col("input_json"))), "\n", "tool")


def path(sessions: DataFrame, calls: DataFrame) -> DataFrame:
    every = sessions.select("session_id", F.col("project_path").alias("p")).filter("p is not null").unionAll(calls.select("session_id", F.explode(t.call_paths(F.col("input_json"))).alias("p")))
    return every.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("p")), "\n").alias("path"))


def error(turns: DataFrame, results: DataFrame) -> DataFrame:
    """By turn: the failed results, then the assistant's lines that speak of an error."""
    failed = results.filter("is_error").select("session_id", "turn_index", F.lit(0).alias("kind"), F.col("result_seq").cast("int").alias("seq"), F.left("content", F.lit(PIECE_CAP)).alias("piece"))
    lines = turns.filter("role = 'assistant'").select("session_id", "turn_index", F.lit(1).alias("kind"), F.posexplode(t.error_lines(F.col("text"))).alias("seq", "piece")).withColumn("piece", F.btrim("piece"))
    return _joined(failed.unionAll(lines), ["turn_index", "kind", "seq"], F.col("piece"), "\n", "error")


def code(turns: DataFrame, calls: DataFrame) -> DataFrame:
    """By turn: its fenced blocks, then what its calls write."""
    blocks = turns.select("session_id", "turn_index", F.lit(-1).alias("call_seq"), F.posexplode(t.code_blocks(F.col("text"))).alias("seq", "piece"))
    keys = F.array(*[F.left(F.nullif(F.get_json_object("input_json", f"$.{k}"), F.lit("")), F.lit(PIECE_CAP)) for k in ("new_string", "content")])
    written = calls.select("session_id", "turn_index", F.col("call_seq").cast("int").alias("call_seq"), F.posexplode(keys).alias("seq", "piece"))
    return _joined(blocks.unionAll(written), ["turn_index", "call_seq", "seq"], F.col("piece"), "\n---\n", "code")


def session_extracts(sessions: DataFrame, turns: DataFrame, calls: DataFrame, results: DataFrame, cap: int = TEXT_CAP) -> DataFrame:
    """(session_id, content, tool, path, error, code), redacted and then cut to cap; what a session lacks is said in brackets."""
    out = content(sessions, turns)
    for part, none in ((tool(calls), "(no tool calls)"), (path(sessions, calls), "(no paths)"), (error(turns, results), "(no errors)"), (code(turns, calls), "(no code)")):
        name = part.columns[-1]
        out = out.join(part, "session_id", "left").withColumn(name, F.coalesce(name, F.lit(none)))
    return out.select("session_id", *[F.left(t.redact(F.col(c)), F.lit(cap)).alias(c) for c in ("content", "tool", "path", "error", "code")])


def enrichment(sessions: DataFrame, turns: DataFrame, calls: DataFrame, results: DataFrame) -> DataFrame:
    """(session_id, intent, outcome, arc, topic, entities) of every session; one without calls is mixed."""
    ordered = calls.withColumn("seq", F.col("turn_index").cast("bigint") * (1 << 20) + F.col("call_seq"))
    given = results.withColumn("seq", F.col("turn_index").cast("bigint") * (1 << 20) + F.col("result_seq"))
    ok = enrich.last_shell_ok(ordered, given)
    first = turns.filter("role = 'user'").groupBy("session_id").agg(F.min_by("text", "turn_index").alias("said"))
    out = sessions.join(enrich.intent(ordered), "session_id", "left").join(enrich.outcome(turns, ok), "session_id", "left").join(enrich.arc(ordered, given), "session_id", "left").join(enrich.session_entities(calls, turns), "session_id", "left").join(first, "session_id", "left")
    topic = enrich.topic(F.col("title"), F.coalesce("project_name", F.lit("session")), F.coalesce("said", F.lit("")))
    return out.select("session_id", F.coalesce("intent", F.lit("mixed")).alias("intent"), F.coalesce("outcome", F.lit("partial")).alias("outcome"), F.coalesce("arc", F.lit("mixed")).alias("arc"), topic.alias("topic"), F.coalesce("entities", F.array().cast("array<string>")).alias("entities"))


def summaries(sessions: DataFrame, calls: DataFrame, results: DataFrame, limit: int = 60) -> DataFrame:
    """The newest sessions, unknown starts last, with the eleven columns that a list of them shows; unknown texts are empty."""
    tools = calls.groupBy("session_id").agg(F.count(F.lit(1)).alias("tool_count"))
    bad = results.groupBy("session_id").agg(F.max("is_error").alias("has_errors"))
    # Only the sessions that are shown are joined to their counts.
    first = sessions.orderBy(F.desc_nulls_last("start_ts"), "session_id").limit(limit)
    out = first.join(tools, "session_id", "left").join(bad, "session_id", "left").orderBy(F.desc_nulls_last("start_ts"), "session_id")
    text = lambda c, name: F.coalesce(c, F.lit("")).alias(name)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
    return out.select("session_id", *[text(F.col(c), c) for c in ("project_name", "project_path", "git_branch", "title")], text(iso("start_ts"), "start_iso"), text(iso("end_ts"), "end_iso"), "user_turns", "assistant_turns", F.coalesce("tool_count", F.lit(0)).alias("tool_count"), F.coalesce("has_errors", F.lit(False)).alias("has_errors"))


def refresh(points: DataFrame, enriched: DataFrame) -> DataFrame:
    """The points with new enrichment where there is some; running it again changes nothing. Both have session_id."""
    columns = [c for c in enriched.columns if c != "session_id"]
    new = enriched.select("session_id", F.struct(*columns).alias("_new"))
    kept = points.join(new, "session_id", "left")
    old = lambda c: F.col(c) if c in points.columns else F.lit(None)
    return kept.select(*[c for c in points.columns if c not in columns], *[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(old(c)).alias(c) for c in columns])
