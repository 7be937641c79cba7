"""Readers of append-only session logs in three JSONL formats, as tables of sessions, turns, calls and results.

Lines are read with Spark's text reader and parsed as VARIANT; no schema is inferred. A line's place is that of its split in the file
and its order within the split, so a long log is read in parts. What depends on order within a file is done by windows over its lines.
A root that doesn't exist, or has no logs, gives empty tables.

Tables: sessions(session_id, source_path, source_agent, project_path, project_name, git_branch, agent_version, title, start_ts,
end_ts, user_turns, assistant_turns, system_events, other_events), turns(session_id, turn_index, uuid, parent_uuid, ts, role,
is_sidechain, text), calls(session_id, turn_index, call_seq, call_id, name, input_json), results(session_id, turn_index,
result_seq, call_id, content, is_error), bad(source_path, reason).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from turnstone.functions import text as t
from turnstone.sources.shared import written

AGENTS = ("claude_code", "codex", "legacy")


class Sessions(NamedTuple):
    sessions: DataFrame
    turns: DataFrame
    calls: DataFrame
    results: DataFrame
    bad: DataFrame


def _text(spark: SparkSession, root: str, glob: str, recursive: bool, since: Column | None = None) -> DataFrame:
    """(source_path, split, place, line) of all lines under root, or of files changed since then; empty where there is no root."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob)
    try:
        files = reader.schema("source_path string, place bigint, line string").parquet(root) if glob == PACKED else reader.text(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "source_path string, split bigint, place bigint, line string")
    if since is not None:
        files = files.filter(F.col("_metadata.file_modification_time") >= since)
    if glob == PACKED:
        return files.select("source_path", F.lit(0).cast("bigint").alias("split"), "place", "line")
    return files.select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))


#: The files of packed logs, and how they are told from text.
PACKED = "*.parquet"


def pack(lines: DataFrame, folder: str) -> None:
    """Whole logs as an archive that readers take in place of files of their own, with the glob PACKED; lines: source_path, place, line.

    Many short logs as files each cost a request, a task's share and the driver's memory; archived ones cost what their lines do.
    """
    lines.select("source_path", F.col("place").cast("bigint").alias("place"), F.col("line").cast("string").alias("line")).write.parquet(folder)


def lines(spark: SparkSession, root: str, glob: str = "*.jsonl", recursive: bool = True) -> DataFrame:
    """(source_path, line_no, line) of all non-blank lines under root, numbered in file order; sub-agents' folders are left out."""
    return _numbered(_text(spark, root, glob, recursive))


def _numbered(text: DataFrame) -> DataFrame:
    own = text.filter(~F.contains("source_path", F.lit("/subagents/")))
    number = F.row_number().over(Window.partitionBy("source_path").orderBy("split", "place")) - 1
    return own.select("source_path", number.alias("line_no"), F.btrim("line", F.lit(" \t\r")).alias("line")).filter("line <> ''")


def _get(v: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v), path, kind)


def _stem(path: Column) -> Column:
    return F.regexp_replace(t.basename(path), r"\.[A-Za-z]+$", "")


def _first(value: Column, order: str = "line_no") -> Column:
    return F.min_by(value, F.when(value.isNotNull(), F.col(order)))


#: A message's items with the fields that count. What has another type is null, and what isn't an object is null as a whole.
ITEMS = "array<struct<type string, text string, id string, name string, input variant, tool_use_id string, content variant, is_error boolean>>"


def _parts_of(items: Column) -> tuple[Column, Column, Column]:
    """The text of a message's items (ITEMS), its calls and its results."""
    of = lambda v, kind: F.try_variant_get(v, "$", kind)
    # A result's content is a string or an array of items with text.
    body = lambda c: F.coalesce(F.when(of(c, "array<variant>").isNull(), of(c, "string")), F.array_join(F.filter(of(c, "array<struct<text string>>")["text"], lambda s: s.isNotNull()), "\n"), F.lit(""))
    texts = F.array_join(F.transform(F.filter(items, lambda i: i["type"] == "text"), lambda i: F.coalesce(i["text"], F.lit(""))), "\n")
    calls = F.transform(F.filter(items, lambda i: i["type"] == "tool_use"), lambda i: F.struct(i["id"].alias("call_id"), i["name"].alias("name"), F.to_json(i["input"]).alias("input_json")))
    results = F.transform(F.filter(items, lambda i: i["type"] == "tool_result"), lambda i: F.struct(i["tool_use_id"].alias("call_id"), body(i["content"]).alias("content"), F.coalesce(i["is_error"], F.lit(False)).alias("is_error")))
    return texts, calls, results


def read_claude(spark: SparkSession, root: str, glob: str = "*.jsonl") -> Sessions:
    """One session a file. A line that isn't JSON fails its file, which goes to bad with the line's number."""
    return _claude(lines(spark, root, glob))


def _claude(own: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Sessions:
    """keep: makes a table that is read several times."""
    raw = own.withColumn("v", F.try_parse_json("line"))
    bad = raw.groupBy("source_path").agg(F.min(F.when(F.col("v").isNull(), F.col("line_no"))).alias("at")).filter("at is not null").select("source_path", F.concat(F.lit("line "), (F.col("at") + 1).cast("string"), F.lit(" is not JSON")).alias("reason"))
    # A file's lines lie together already, as they are numbered, so this moves none again.
    good = raw.withColumn("fails", F.max(F.col("v").isNull()).over(Window.partitionBy("source_path"))).filter("not fails")
    e = good.select("source_path", "line_no", "v", _get("v", "$.type").alias("type"), F.try_to_timestamp(_get("v", "$.timestamp")).alias("ts"))
    facts = e.groupBy("source_path").agg(
        F.coalesce(_first(_get("v", "$.sessionId")), _stem(F.first("source_path"))).alias("session_id"),
        _first(_get("v", "$.cwd")).alias("project_path"), _first(_get("v", "$.gitBranch")).alias("git_branch"), _first(_get("v", "$.version")).alias("agent_version"),
        _first(F.when(F.col("type") == "ai-title", F.coalesce(_get("v", "$.aiTitle"), _get("v", "$.title")))).alias("own_title"),
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
        F.count_if(F.col("type") == "user").alias("user_turns"), F.count_if(F.col("type") == "assistant").alias("assistant_turns"), F.count_if(F.col("type") == "system").alias("system_events"), F.count_if(~F.coalesce(F.col("type"), F.lit("")).isin("user", "assistant", "system")).alias("other_events"),
    )
    spoken = e.filter(F.col("type").isin("user", "assistant") & _get("v", "$.uuid").isNotNull())
    content, items = _get("v", "$.message.content"), _get("v", "$.message.content", ITEMS)
    texts, calls, results = _parts_of(F.col("items"))
    turns = spoken.select("source_path", "line_no", "ts", F.col("type").alias("role"), _get("v", "$.uuid").alias("uuid"), _get("v", "$.parentUuid").alias("parent_uuid"), F.coalesce(_get("v", "$.isSidechain", "boolean"), F.lit(False)).alias("is_sidechain"), items.alias("items"), F.when(items.isNull(), content).alias("plain"))
    turns = turns.withColumn("turn_index", F.row_number().over(Window.partitionBy("source_path").orderBy("line_no")) - 1)
    turns = turns.select("source_path", "turn_index", "uuid", "parent_uuid", "ts", "role", "is_sidechain", F.btrim(F.coalesce("plain", texts, F.lit("")), F.lit(" \t\n\r")).alias("text"), F.coalesce(calls, F.array()).alias("calls"), F.coalesce(results, F.array()).alias("results"))
    return _assemble(keep(facts.withColumn("source_agent", F.lit("claude_code"))), keep(turns), bad)


def spoken_turns(lines: DataFrame, *also: str) -> DataFrame:
    """(session_id, ts, uuid, role, project_path, text, calls, results) of the turns among lines (column line; `also`: further columns to
    keep), whatever files they are in.

    For logs that grow by new files: the session is named in each line, and its turns are in order by time, then uuid. Lines that
    aren't JSON, or no turns, are left out.
    """
    # As an array's element a line's value is worked out once: what filters turns is put below a plain column, and would parse the line again.
    v = lines.select(*also, F.explode(F.array(F.try_parse_json("line"))).alias("v"))
    items = _get("v", "$.message.content", ITEMS)
    e = v.select(*also, _get("v", "$.sessionId").alias("session_id"), F.try_to_timestamp(_get("v", "$.timestamp")).alias("ts"), _get("v", "$.uuid").alias("uuid"), _get("v", "$.type").alias("role"), _get("v", "$.cwd").alias("project_path"), items.alias("items"), F.when(items.isNull(), _get("v", "$.message.content")).alias("plain"))
    texts, calls, results = _parts_of(F.col("items"))
    text = F.btrim(F.coalesce("plain", texts, F.lit("")), F.lit(" \t\n\r"))
    return e.filter(F.col("role").isin("user", "assistant") & F.col("uuid").isNotNull() & F.col("session_id").isNotNull()).select("session_id", "ts", "uuid", "role", "project_path", text.alias("text"), F.coalesce(calls, F.array()).alias("calls"), F.coalesce(results, F.array()).alias("results"), *also)


def _assemble(facts: DataFrame, turns: DataFrame, bad: DataFrame) -> Sessions:
    """The normal tables. Titles: the log's own, else of the first user turn that isn't noise, else of the first user turn."""
    user = turns.filter("role = 'user' and trim(text) <> ''").groupBy("source_path").agg(F.min_by("text", F.when(~t.is_noise(F.col("text")), F.col("turn_index"))).alias("a"), F.min_by("text", "turn_index").alias("b"))
    sessions = facts.join(user, "source_path", "left").select(
        "session_id", "source_path", "source_agent", "project_path", F.coalesce("project_name", t.basename(F.col("project_path"))).alias("project_name") if "project_name" in facts.columns else t.basename(F.col("project_path")).alias("project_name"),
        "git_branch", "agent_version", F.coalesce("own_title", t.title_of(F.coalesce("a", "b"))).alias("title"), "start_ts", "end_ts", "user_turns", "assistant_turns", "system_events", "other_events",
    )
    named = turns.join(facts.select("source_path", "session_id"), "source_path")
    calls = named.select("session_id", "turn_index", F.posexplode("calls").alias("call_seq", "c")).select("session_id", "turn_index", "call_seq", "c.*")
    results = named.select("session_id", "turn_index", F.posexplode("results").alias("result_seq", "r")).select("session_id", "turn_index", "result_seq", "r.*")
    return Sessions(sessions, named.select("session_id", "turn_index", "uuid", "parent_uuid", "ts", "role", "is_sidechain", "text"), calls, results, bad)


def read_legacy(spark: SparkSession, root: str, glob: str = "ses_*.jsonl") -> Sessions:
    """Transcripts `ses_*.jsonl`: calls and results up to the next user line make one assistant turn. Lines that aren't JSON are skipped."""
    e = lines(spark, root, glob, recursive=False).withColumn("v", F.try_parse_json("line")).filter("v is not null").select("source_path", "line_no", _get("v", "$.type").alias("type"), _get("v", "$.timestamp").alias("raw_ts"), _get("v", "$.content").alias("content"), _get("v", "$.tool_name").alias("name"), F.to_json(F.try_variant_get("v", "$.tool_input", "variant")).alias("input_json"), _get("v", "$.tool_output").alias("output"))
    by_file = Window.partitionBy("source_path").orderBy("line_no")
    e = e.filter(F.col("type").isin("user", "tool_use", "tool_result")).withColumn("seq", F.sum((F.col("type") == "user").cast("int")).over(by_file))
    e = e.withColumn("role", F.when(F.col("type") == "user", "user").otherwise("assistant")).withColumn("n_call", F.sum((F.col("type") == "tool_use").cast("int")).over(by_file))
    stem = _stem(F.col("source_path"))
    call_id = F.concat(stem, F.lit("-tu"), F.col("n_call").cast("string"))
    failed = F.rlike(F.lower(F.coalesce("output", F.lit(""))), F.lit("error:|traceback|panic|command failed"))
    grouped = e.groupBy("source_path", "seq", "role").agg(
        F.min("line_no").alias("line_no"), F.min("raw_ts").alias("raw_ts"), F.coalesce(F.min_by("content", F.when(F.col("type") == "user", F.col("line_no"))), F.lit("")).alias("text"),
        F.array_sort(F.collect_list(F.when(F.col("type") == "tool_use", F.struct("line_no", call_id.alias("call_id"), "name", "input_json")))).alias("c"),
        F.array_sort(F.collect_list(F.when(F.col("type") == "tool_result", F.struct("line_no", call_id.alias("call_id"), F.coalesce("output", F.lit("")).alias("content"), failed.alias("is_error"))))).alias("r"),
    )
    order = Window.partitionBy("source_path").orderBy("line_no")
    turns = grouped.select(
        "source_path", (F.row_number().over(order) - 1).alias("turn_index"), F.concat(stem, F.when(F.col("role") == "user", "-u").otherwise("-a"), F.col("seq").cast("string")).alias("uuid"), F.lit(None).cast("string").alias("parent_uuid"), F.try_to_timestamp("raw_ts").alias("ts"), "role", F.lit(False).alias("is_sidechain"), F.btrim("text").alias("text"),
        F.transform("c", lambda x: F.struct(x["call_id"].alias("call_id"), x["name"].alias("name"), x["input_json"].alias("input_json"))).alias("calls"), F.transform("r", lambda x: F.struct(x["call_id"].alias("call_id"), x["content"].alias("content"), x["is_error"].alias("is_error"))).alias("results"),
    )
    none = F.lit(None).cast("string")
    facts = e.groupBy("source_path").agg(F.min(F.try_to_timestamp("raw_ts")).alias("start_ts"), F.max(F.try_to_timestamp("raw_ts")).alias("end_ts")).join(turns.groupBy("source_path").agg(F.count_if(F.col("role") == "user").alias("user_turns"), F.count_if(F.col("role") == "assistant").alias("assistant_turns")), "source_path")
    facts = facts.select("*", stem.alias("session_id"), F.lit("legacy").alias("source_agent"), none.alias("project_path"), F.lit("(legacy transcript)").alias("project_name"), none.alias("git_branch"), none.alias("agent_version"), none.alias("own_title"), F.lit(0).cast("bigint").alias("system_events"), F.lit(0).cast("bigint").alias("other_events"))
    return _assemble(facts, turns, spark.createDataFrame([], "source_path string, reason string"))


def _rollout_turns(items: DataFrame) -> DataFrame:
    """Turns of items (source_path, line_no, ts, payload): calls go to the latest assistant turn, outputs to the next user turn after
    the latest turn before them that owns the call. Where there is none to take a call or an output, a turn is made for it; what
    follows finds the made turn like any other. Outputs of unknown calls are dropped.

    All is windows over a file's lines. A call needs a turn made if no assistant line precedes it in its file, so only the first
    call of such a file does. An output takes the first user message after its owner's line; one is made at the first output that
    finds none between its owner and itself, and later outputs of owners before it take that.
    """
    p = F.try_parse_json("payload")
    get = lambda path: F.try_variant_get(p, path, "string")
    texts = F.filter(F.transform(F.try_variant_get(p, "$.content", "array<variant>"), lambda x: F.when(F.schema_of_variant(x) != "STRING", F.try_variant_get(x, "$.text", "string"))), lambda x: x.isNotNull())
    output = F.try_variant_get(p, "$.output", "variant")
    e = items.select("source_path", "line_no", "ts", get("$.type").alias("kind"), get("$.role").alias("role"), F.btrim(F.array_join(texts, "\n"), F.lit(" \t\n\r")).alias("text"), F.coalesce(get("$.call_id"), F.lit("")).alias("call_id"), F.coalesce(get("$.name"), F.lit("")).alias("name"), get("$.arguments").alias("input_json"), F.coalesce(F.when(F.schema_of_variant(output) == "STRING", get("$.output")), F.to_json(output)).alias("content"))
    e = e.filter((F.col("kind") == "message") & F.col("role").isin("user", "assistant") & (F.col("text") != "") | F.col("kind").isin("function_call", "function_call_output"))
    upto = Window.partitionBy("source_path").orderBy("line_no")
    before = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = upto.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    said = lambda role: F.when((F.col("kind") == "message") & (F.col("role") == role), F.col("line_no"))
    e = e.withColumn("first_call", F.min(F.when(F.col("kind") == "function_call", F.col("line_no"))).over(Window.partitionBy("source_path"))).withColumn("said_at", F.max(said("assistant")).over(before))
    # A call before any assistant message makes a turn, once; it is the latest one until the next message.
    makes = (F.col("kind") == "function_call") & F.col("said_at").isNull() & (F.col("line_no") == F.col("first_call"))
    owns = F.when(makes, F.col("line_no")).otherwise(said("assistant"))
    e = e.withColumn("makes_call", makes).withColumn("owns", owns).withColumn("next_user", F.min(said("user")).over(after))
    e = e.withColumn("owner", F.max("owns").over(before)).withColumn("owner_user", F.last(F.when(F.col("owns").isNotNull(), F.struct("next_user")), ignorenulls=True).over(before)["next_user"])
    calls = e.filter("kind = 'function_call'").select("source_path", "line_no", "owner", "owner_user", "call_id", "name", "input_json")
    outs = e.filter("kind = 'function_call_output'").select("source_path", "line_no", "ts", "call_id", "content")
    # The latest owner before the output, and the first user message after it if that came before the output too.
    asked = outs.join(calls.select("source_path", F.col("line_no").alias("call_at"), "owner", "owner_user", "call_id"), ["source_path", "call_id"]).filter("call_at < line_no")
    taken = asked.groupBy("source_path", "line_no").agg(F.max(F.struct("owner", "owner_user")).alias("o"), F.first("ts").alias("ts"), F.first("call_id").alias("call_id"), F.first("content").alias("content"))
    taken = taken.select("source_path", "line_no", "o.owner", "ts", "call_id", "content", F.when(F.col("o.owner_user") < F.col("line_no"), F.col("o.owner_user")).alias("taker"))
    made = taken.filter("taker is null").groupBy("source_path").agg(F.array_sort(F.collect_list(F.struct("line_no", "owner"))).alias("lone")).select("source_path", _made_at(F.col("lone")).alias("made"))
    placed = taken.join(made, "source_path", "left").withColumn("made_at", F.array_min(F.filter("made", lambda m: (m > F.col("owner")) & (m <= F.col("line_no")))))
    placed = placed.withColumn("turn_at", F.least("taker", "made_at"))
    heads = e.filter(F.col("kind") == "message").select("source_path", F.col("line_no").alias("turn_at"), "role", "ts", "text", F.col("role").alias("form"))
    stubs = e.filter("makes_call").select("source_path", F.col("line_no").alias("turn_at"), F.lit("assistant").alias("role"), "ts", F.lit("").alias("text"), F.lit("fc-stub").alias("form"))
    takers = placed.filter("turn_at = made_at and line_no = made_at").select("source_path", "turn_at", F.lit("user").alias("role"), "ts", F.lit("").alias("text"), F.lit("fo-stub").alias("form"))
    own_calls = calls.groupBy("source_path", F.col("owner").alias("turn_at")).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "call_id", "name", "input_json"))), lambda c: F.struct(c["call_id"].alias("call_id"), c["name"].alias("name"), c["input_json"].alias("input_json"))).alias("calls"))
    own_outs = placed.groupBy("source_path", "turn_at").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "call_id", "content"))), lambda r: F.struct(r["call_id"].alias("call_id"), r["content"].alias("content"), t.looks_like_error(r["content"]).alias("is_error"))).alias("results"))
    every = heads.unionAll(stubs).unionAll(takers).withColumn("turn_index", F.row_number().over(Window.partitionBy("source_path").orderBy("turn_at")) - 1)
    none_c, none_r = F.array().cast("array<struct<call_id:string,name:string,input_json:string>>"), F.array().cast("array<struct<call_id:string,content:string,is_error:boolean>>")
    return every.join(own_calls, ["source_path", "turn_at"], "left").join(own_outs, ["source_path", "turn_at"], "left").select("source_path", "turn_index", F.concat(F.lit("codex-"), F.col("form"), F.lit("-"), F.col("turn_index").cast("string")).alias("uuid"), F.lit(None).cast("string").alias("parent_uuid"), F.try_to_timestamp("ts").alias("ts"), "role", F.lit(False).alias("is_sidechain"), "text", F.coalesce("calls", none_c).alias("calls"), F.coalesce("results", none_r).alias("results"))


def _made_at(lone: Column) -> Column:
    """The lines at which turns are made for outputs (line_no, owner; in order of lines): each that has no made one after its owner."""
    start = F.array().cast("array<int>")
    return F.aggregate(lone, start, lambda made, x: F.when(F.exists(made, lambda m: m > x["owner"]), made).otherwise(F.concat(made, F.array(x["line_no"].cast("int")))))


def read_rollouts(spark: SparkSession, root: str, glob: str = "rollout-*.jsonl") -> Sessions:
    """Logs `rollout-*.jsonl` with envelopes. A file whose first session_meta doesn't come before its items is bad."""
    e = lines(spark, root, glob).withColumn("v", F.try_parse_json("line")).filter("v is not null")
    e = e.select("source_path", "line_no", _get("v", "$.type").alias("type"), _get("v", "$.timestamp").alias("raw_ts"), F.try_variant_get("v", "$.payload", "variant").alias("p")).withColumn("ts", F.try_to_timestamp("raw_ts"))
    meta = F.col("type") == "session_meta"
    facts = e.groupBy("source_path").agg(
        F.min(F.when(meta, F.col("line_no"))).alias("meta_at"), F.min(F.when(F.col("type") == "response_item", F.col("line_no"))).alias("item_at"),
        _first(F.when(meta, _get("p", "$.id"))).alias("session_id"), _first(F.when(meta, _get("p", "$.cwd"))).alias("project_path"), _first(F.when(meta, _get("p", "$.cli_version"))).alias("agent_version"),
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count_if(~F.coalesce(F.col("type"), F.lit("")).isin("session_meta", "response_item")).alias("other_events"),
    )
    ok = F.coalesce(F.col("meta_at") < F.coalesce("item_at", F.lit(2**31 - 1)), F.lit(False))
    bad = facts.filter(~ok).select("source_path", F.lit("no session_meta before the first item").alias("reason"))
    items = e.filter("type = 'response_item'").join(bad, "source_path", "left_anti").select("source_path", "line_no", F.col("raw_ts").alias("ts"), F.to_json("p").alias("payload"))
    turns = _rollout_turns(items)
    counts = turns.groupBy("source_path").agg(F.count_if(F.col("role") == "user").alias("user_turns"), F.count_if(F.col("role") == "assistant").alias("assistant_turns"), F.left(F.regexp_replace(F.min_by("text", F.when((F.col("role") == "user") & (F.col("text") != ""), F.col("turn_index"))), r"\n", " "), F.lit(60)).alias("own_title"))
    none = F.lit(None).cast("string")
    facts = facts.filter(ok).join(counts, "source_path", "left").select("source_path", "session_id", "project_path", "agent_version", "start_ts", "end_ts", "other_events", F.coalesce("user_turns", F.lit(0)).alias("user_turns"), F.coalesce("assistant_turns", F.lit(0)).alias("assistant_turns"), "own_title", F.lit(0).cast("bigint").alias("system_events"), none.alias("git_branch"), F.lit("codex").alias("source_agent"))
    return _assemble(facts, turns, bad)


def recent_errors(spark: SparkSession, root: str, since: Column, glob: str = "*.jsonl", turns: int = 6, size: int = 800) -> DataFrame:
    """(session_id, project_name, turn_index, error_text) of the logs that were changed at `since` or later: the newest error among each one's last turns.

    Older files, or archives, are left out by their time, before a line is read. Of a turn its last error counts; one that only tells of a slip in
    the shell is passed over together with its turn.
    """
    got = _claude(_numbered(_text(spark, root, glob, True, since)), lambda df: written(df, "recent"))
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn_index")))
    last = got.turns.select("session_id", "turn_index", back.alias("back")).filter(F.col("back") <= turns)
    bad = got.results.filter("is_error").groupBy("session_id", "turn_index").agg(F.max_by("content", "result_seq").alias("content"))
    own = bad.join(last, ["session_id", "turn_index"]).withColumn("error_text", F.left("content", F.lit(size))).filter(~t.is_shell_slip(F.col("error_text")))
    newest = own.groupBy("session_id").agg(F.max("turn_index").alias("turn_index"), F.max_by("error_text", "turn_index").alias("error_text"))
    return newest.join(got.sessions.select("session_id", F.coalesce("project_name", F.lit("")).alias("project_name")), "session_id").select("session_id", "project_name", "turn_index", "error_text")


def kind_of(spark: SparkSession, root: str) -> str:
    """The agent whose logs lie under root, by the names of the files down to four levels; claude_code where none tells."""
    try:
        names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{rollout-*,ses_*}.jsonl").load(root).select("path")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return "claude_code"
    depth = F.size(F.split("path", "/")) - len(root.rstrip("/").removeprefix("file://").split("/"))
    found = names.filter(depth <= 6).agg(F.max(F.contains("path", F.lit("/rollout-"))), F.max(F.contains("path", F.lit("/ses_")))).first()
    return "codex" if found[0] else "legacy" if found[1] else "claude_code"


def read_all(spark: SparkSession, roots: dict[str, str]) -> Sessions:
    """All roots as one; roots: agent -> folder, where the agent "auto" stands for what the folder's files tell. An error only if every root is bad."""
    readers = {"claude_code": read_claude, "codex": read_rollouts, "legacy": read_legacy}
    parts = [readers[kind_of(spark, root) if agent == "auto" else agent](spark, root) for agent, root in roots.items()]
    if not parts:
        raise ValueError("no roots")
    merged = []
    for tables in zip(*parts):
        out = tables[0]
        for x in tables[1:]:
            out = out.unionByName(x)
        merged.append(out)
    both = Sessions(*merged)
    if both.sessions.isEmpty() and not both.bad.isEmpty():
        raise ValueError("no file could be read")
    return both


def prompt_history(spark: SparkSession, path: str) -> DataFrame:
    """(ts_ms, project) of a prompt history; lines that aren't JSON, or have no time, are left out."""
    v = _text(spark, path, "*", False).withColumn("v", F.try_parse_json("line")).filter("v is not null")
    return v.select(F.coalesce(_get("v", "$.timestamp", "bigint").cast("string"), _get("v", "$.timestamp")).alias("ts_ms"), _get("v", "$.project").alias("project")).filter("ts_ms is not null")


def embed(texts: DataFrame, dim: int = 384) -> DataFrame:
    """(…, vec): a deterministic hashing embedder, unit length; null for a text without tokens. A model's function can take its place."""
    import numpy as np
    import pyarrow as pa

    at = texts.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        import zlib

        for batch in batches:
            out = []
            for s in batch.column(at).to_pylist():
                v = np.zeros(dim)
                for w in re.findall(r"[^\W_]+", (s or "").lower()):
                    h = zlib.crc32(w.encode())
                    v[h % dim] += 1 if h >> 31 else -1
                n = np.sqrt(v @ v)
                out.append((v / n).tolist() if n else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names, "vec"])

    return texts.mapInArrow(run, texts.select("*", F.lit(None).cast("array<double>").alias("vec")).schema)
