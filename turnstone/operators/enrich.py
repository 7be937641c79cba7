"""Deterministic enrichment of sessions from their turns, tool calls and results.

calls: session_id, seq, name, input_json, call_id; results: session_id, seq, call_id, content, is_error; turns: session_id,
turn_index, role, text. seq orders calls and results within a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnstone.functions import text as t

#: The keys of a tool's input that may name a path or a pattern.
ENTITY_KEYS = ["file_path", "path", "notebook_path", "pattern"]
#: Tool families, and the words that tell an outcome.
SHELL, EDIT, READ = ["Bash"], ["Edit", "MultiEdit", "Write"], ["Read"]
POSITIVE = ["resolved", "fixed", "works", "done", "success", "complete"]
NEGATIVE = ["fail", "error", "stuck", "broken", "cannot", "unable"]


def _share(names: list[str]) -> Column:
    return F.count_if(F.col("name").isin(names)) / F.count(F.lit(1))


def intent(calls: DataFrame, shell: list[str] = SHELL, edit: list[str] = EDIT, read: list[str] = READ, over: float = 0.4) -> DataFrame:
    """build, impl or debug by the share of shell, edit and read calls, in that order; else mixed."""
    shares = calls.groupBy("session_id").agg(_share(shell).alias("shell"), _share(edit).alias("edit"), _share(read).alias("read"))
    return shares.select("session_id", F.when(F.col("shell") > over, "build").when(F.col("edit") > over, "impl").when(F.col("read") > over, "debug").otherwise("mixed").alias("intent"))


def _last(text: Column, words: list[str]) -> Column:
    """The place where the last of the words begins; 0 for none."""
    size = F.length(text)
    back = lambda w: F.when(F.locate(w[::-1], F.reverse(text)) > 0, size - F.locate(w[::-1], F.reverse(text)) - len(w) + 2).otherwise(0)
    return F.greatest(*[back(w) for w in words])


def outcome_of(text: Column) -> Column:
    """resolved or unresolved by the words in a text, where both occur by the later; else partial."""
    low = F.lower(text)
    good, bad = _last(low, POSITIVE), _last(low, NEGATIVE)
    return F.when((good > 0) & (good > bad), "resolved").when(bad > 0, "unresolved").otherwise("partial")


def outcome(turns: DataFrame, shell_ok: DataFrame | None = None) -> DataFrame:
    """By the last assistant text; a session whose last shell call succeeded is resolved whatever it says."""
    last = turns.filter("role = 'assistant'").groupBy("session_id").agg(F.max_by("text", "turn_index").alias("text"))
    said = last.select("session_id", outcome_of(F.coalesce("text", F.lit(""))).alias("outcome"))
    if shell_ok is None:
        return said
    return said.join(shell_ok, "session_id", "left").select("session_id", F.when(F.col("ok"), "resolved").otherwise(F.col("outcome")).alias("outcome"))


def last_shell_ok(calls: DataFrame, results: DataFrame, shell: list[str] = SHELL) -> DataFrame:
    """(session_id, ok) of each session's last shell call by the first result with its id; null without a result."""
    last = calls.filter(F.col("name").isin(shell)).groupBy("session_id").agg(F.max_by("call_id", "seq").alias("call_id"))
    first = results.groupBy("session_id", "call_id").agg(F.min_by(F.struct("is_error", F.lower("content").alias("content")), "seq").alias("r"))
    r = F.col("r")
    ok = F.when(r.isNull(), None).when(r["is_error"], False).when(F.contains(r["content"], F.lit("exit code 0")), True).otherwise(~F.rlike(r["content"], F.lit("error|failed")))
    return last.join(first, ["session_id", "call_id"], "left").select("session_id", ok.alias("ok"))


def arc(calls: DataFrame, results: DataFrame, shell: list[str] = SHELL, edit: list[str] = EDIT, read: list[str] = READ) -> DataFrame:
    """The shape of a session: a failing shell call, then reading and editing, then a shell call that works is debug-fix; editing and
    then a shell call that works is fix; mostly edits without a shell is impl; mostly reads without edits is explore; else mixed."""
    errors = results.groupBy("session_id", "call_id").agg(F.max_by(F.col("is_error") | F.rlike(F.lower("content"), F.lit("error|failed|exit code 1")), "seq").alias("bad"))
    c = calls.join(errors, ["session_id", "call_id"], "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    is_shell, is_edit, is_read = (F.col("name").isin(x) for x in (shell, edit, read))
    facts = c.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_edit).alias("edits"), F.count_if(is_read).alias("reads"), F.count_if(is_shell).alias("shells"),
        F.min(F.when(is_shell & F.col("bad"), F.col("seq"))).alias("first_bad"), F.max(F.when(is_shell & ~F.col("bad"), F.col("seq"))).alias("last_good"),
        F.array_sort(F.collect_list(F.when(is_edit, F.col("seq")))).alias("edit_at"), F.min(F.when(is_edit, F.col("seq"))).alias("first_edit"),
    )
    between = F.exists("edit_at", lambda e: (e > F.col("first_bad")) & (e < F.col("last_good")))
    return facts.select("session_id", F.when(F.coalesce(between, F.lit(False)), "debug-fix").when(F.col("first_edit") < F.col("last_good"), "fix").when((F.col("edits") * 2 >= F.col("n")) & (F.col("shells") == 0), "impl").when((F.col("reads") * 2 >= F.col("n")) & (F.col("edits") == 0), "explore").otherwise("mixed").alias("arc"))


def _paths_in(text: Column) -> Column:
    """The path-like tokens of a text."""
    return F.regexp_extract_all(text, F.lit(rf"([{t.WORD}\-./]+\.[{t.WORD}]{{1,5}})"), F.lit(1))


def _as_paths(found: DataFrame) -> DataFrame:
    """Tokens e without punctuation behind them, if they are long enough and have a dot or a slash."""
    return found.select("session_id", F.regexp_replace("e", r"[.,)\]:;]+$", "").alias("e")).filter((F.octet_length("e") >= 3) & F.rlike("e", F.lit("[./]")))


def entities(texts: DataFrame, most: int = 10) -> DataFrame:
    """(session_id, entities): the path-like tokens of a session's texts, the most frequent first, ties by name."""
    return _most_frequent(_as_paths(texts.select("session_id", F.explode(_paths_in(F.col("text"))).alias("e"))), most)


def session_entities(calls: DataFrame, turns: DataFrame, most: int = 10) -> DataFrame:
    """(session_id, entities): what a session is about, the most frequent first, ties by name.

    Of its calls count the paths and patterns of their inputs, and of shell commands the program and the path-like tokens; of its turns
    the path-like tokens of their texts. Urls don't count.
    """
    v = F.try_parse_json("input_json")
    keys = F.array(*[t.payload_get(F.col("v"), k) for k in ENTITY_KEYS])
    parsed = calls.select("session_id", "name", v.alias("v")).select("session_id", keys.alias("given"), F.when(F.col("name").isin(SHELL), t.payload_get(F.col("v"), "command")).alias("command"))
    named = parsed.select("session_id", F.explode(F.concat(F.array_compact("given"), F.coalesce(_paths_in(F.col("command")), F.array().cast("array<string>")))).alias("e"))
    said = turns.select("session_id", F.explode(_paths_in(F.coalesce("text", F.lit("")))).alias("e"))
    programs = parsed.select("session_id", shell_word(F.col("command")).alias("e")).filter("e is not null")
    return _most_frequent(_as_paths(named.unionAll(said)).unionAll(programs), most)


def _most_frequent(kept: DataFrame, most: int) -> DataFrame:
    counted = kept.groupBy("session_id", "e").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("session_id").orderBy(F.desc("n"), "e")
    top = counted.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)
    return top.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "e"))), lambda s: s["e"]).alias("entities"))


def shell_word(command: Column) -> Column:
    """A shell command's program: the first word after sudo, env or time; null for a path or a single character."""
    words = t.words_of(command)
    first = F.when(F.get(words, F.lit(0)).isin("sudo", "env", "time"), F.get(words, F.lit(1))).otherwise(F.get(words, F.lit(0)))
    return F.when((F.octet_length(first) >= 2) & ~F.rlike(first, F.lit(r"[/\\]")), first)


def topic(title: Column, project: Column, text: Column) -> Column:
    """The title, else the project and the first four words of the text outside code."""
    plain = F.lower(F.btrim(F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", " "), r"`[^`]*`", " ")))
    words = F.filter(F.split(plain, r"\s+"), lambda w: w != "")
    return F.coalesce(F.nullif(F.btrim(title), F.lit("")), F.concat(project, F.lit(" · "), F.array_join(F.slice(words, 1, 4), " ")))
