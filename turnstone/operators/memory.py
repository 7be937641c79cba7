"""Project memory (a primer of what was meant, decided and stumbled over) and the digest of a window, as tables and as Markdown.

turns: session_id, turn_index, role, text; calls: session_id, turn_index, name, input_json; results: session_id, turn_index, content,
is_error; sources: session_id, similarity. Decisions are read from the first and last MINED turns of a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnstone.functions import text as t
from turnstone.operators import activity
from turnstone.operators.enrich import shell_word

MINED = 12
MOST = {"intents": 5, "decisions": 8, "pitfalls": 5}


def _firsts(rows: DataFrame, key: Column, order: list[Column], most: int) -> DataFrame:
    """The first row of each key, then the first `most` of those; a reduction by key, then a bounded sort."""
    kept = rows.withColumn("_key", key).filter("_key <> ''").groupBy("_key").agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")
    return kept.orderBy(*order).limit(most)


def sources(sessions: DataFrame, project: str, path: str | None, near: DataFrame | None, limit: int = 8) -> DataFrame:
    """The newest sessions of a project (by name, and by path where given), similarity 1; filled up with near ones (session_id, score) of others."""
    limit = min(32, max(1, limit))
    own = sessions.filter(F.col("project_name") == project)
    if path:
        own = own.filter(F.col("project_path") == path)
    local = own.orderBy(F.desc_nulls_last("start_ts"), "session_id").limit(limit).select("session_id", F.lit(1.0).alias("similarity"))
    have = local.count()
    if have >= limit or near is None:
        return local
    more = near.join(local, "session_id", "left_anti").orderBy(F.desc("score"), "session_id").limit(limit - have).select("session_id", F.col("score").alias("similarity"))
    return local.unionAll(more)


def intents(turns: DataFrame, src: DataFrame, most: int = MOST["intents"]) -> DataFrame:
    """The first meaningful line of each source's first six user turns."""
    w = Window.partitionBy("session_id").orderBy("turn_index")
    user = turns.join(src, "session_id").filter("role = 'user'").withColumn("n", F.row_number().over(w)).filter("n <= 6").withColumn("line", t.meaningful_line("text")).filter("line is not null")
    first = user.groupBy("session_id", "similarity").agg(F.min_by("line", "turn_index").alias("line"))
    return _firsts(first, t.dedup_key(F.col("line")), [-F.col("similarity"), F.col("session_id")], most)


def mined(turns: DataFrame, ends: int = MINED) -> DataFrame:
    """The first and the last turns of each session, each once."""
    w = Window.partitionBy("session_id")
    n = F.row_number().over(w.orderBy("turn_index"))
    back = F.row_number().over(w.orderBy(F.desc("turn_index")))
    return turns.withColumn("_n", n).withColumn("_back", back).filter((F.col("_n") <= ends) | (F.col("_back") <= ends)).drop("_n", "_back")


def decisions(turns: DataFrame, src: DataFrame, most: int = MOST["decisions"]) -> DataFrame:
    """(session_id, turn_index, text, confidence), the surest first; phrases weigh with the similarity of their source, at least half."""
    found = mined(turns).join(src, "session_id").select("session_id", "turn_index", "similarity", F.explode(t.decisions(F.coalesce("text", F.lit("")))).alias("d"))
    sure = found.select("session_id", "turn_index", "d.text", F.round(F.least(F.lit(1.0), F.col("d.confidence") * F.greatest("similarity", F.lit(0.5))), 6).alias("confidence"))
    return _firsts(sure, t.dedup_key(F.col("text")), [-F.col("confidence"), F.col("session_id"), F.col("turn_index")], most)


def pitfalls(results: DataFrame, src: DataFrame, most: int = MOST["pitfalls"]) -> DataFrame:
    """The first useful line of failed results, without what a user's interruption leaves."""
    line = t.clip(F.get(F.filter(F.transform(F.split("content", "\n"), lambda x: F.btrim(x)), lambda x: x != ""), F.lit(0)), 220)
    bad = results.join(src, "session_id").filter("is_error").withColumn("line", line).filter("line is not null")
    noise = F.lit(False)
    for n in t.PITFALL_NOISE:
        noise = noise | F.contains(F.lower("line"), F.lit(n))
    return _firsts(bad.filter(~noise).select("session_id", "turn_index", "line"), F.left(t.dedup_key(F.col("line")), F.lit(80)), [F.col("session_id"), F.col("turn_index")], most)


def stack(calls: DataFrame, src: DataFrame) -> DataFrame:
    """(kind, value, n): the six most used tools, four file extensions of edited or read files, four shell programs."""
    own = calls.join(src.select("session_id"), "session_id")
    file = F.coalesce(F.get_json_object("input_json", "$.file_path"), F.get_json_object("input_json", "$.notebook_path"))
    ext = F.when(F.col("name").isin("Edit", "MultiEdit", "Write", "Read", "NotebookEdit"), F.regexp_extract(file, r"(\.[A-Za-z0-9]+)$", 1))
    command = F.regexp_replace(F.regexp_replace(F.get_json_object("input_json", "$.command"), "^!", ""), '^"', "")
    program = F.when(F.col("name") == "Bash", F.get(F.filter(F.split(command, r"\s+"), lambda w: w != ""), F.lit(0)))
    atoms = own.select(F.explode(F.array(F.struct(F.lit("tool").alias("kind"), F.col("name").alias("value")), F.struct(F.lit("extension").alias("kind"), F.nullif(ext, F.lit("")).alias("value")), F.struct(F.lit("program").alias("kind"), F.when(F.octet_length(program) < 32, program).alias("value")))).alias("x")).select("x.*")
    most = F.when(F.col("kind") == "tool", 6).otherwise(4)
    return activity.top(atoms, "value", 6, "kind").filter(F.col("rank") <= most).select("kind", "value", "n")


def programs(calls: DataFrame) -> DataFrame:
    """(program, n) of all shell calls, paths and single characters left out."""
    return activity.top(calls.select(shell_word(F.get_json_object("input_json", "$.command")).alias("program")), "program", 8)


def primer(turns: DataFrame, calls: DataFrame, results: DataFrame, src: DataFrame, project: str) -> str:
    """The primer as Markdown, harmless when quoted."""
    safe = lambda df, c: df.select(t.defang(F.col(c)).alias(c))
    return activity.markdown(f"Memory of {project}", [("Past intents", safe(intents(turns, src), "line")), ("Decisions", safe(decisions(turns, src), "text")), ("Pitfalls", safe(pitfalls(results, src), "line")), ("Stack", stack(calls, src)), ("Sources", src.orderBy(F.desc("similarity"), "session_id"))])


def digest(sessions: DataFrame, turns: DataFrame, calls: DataFrame, as_of: Column, days: int = 30, cap: int = 20_000) -> str:
    """The digest of a window as Markdown. sessions: session_id, start_ts, agent, project, intent, turns, has_errors and, if known, outcome and arc. cap is part of the
    report: of more sessions than that it covers the newest, and says so."""
    window = activity.in_window(sessions, as_of, days)
    truncated = window.count() > cap
    used = window.orderBy(F.desc_nulls_last("start_ts"), "session_id").limit(cap) if truncated else window
    own = calls.join(used.select("session_id"), "session_id", "left_semi")
    said = decisions(turns.join(used.select("session_id"), "session_id", "left_semi"), used.select("session_id", F.lit(1.0).alias("similarity")), 50).select("session_id", t.dedup_key(F.col("text")).alias("key"))
    sections = [("Fingerprint", activity.fingerprint(used)), ("Tools", activity.top(own, "name", 8)), ("Projects", activity.bars(used, "project")), ("Intents", activity.mix(used, "intent").orderBy(F.desc("n"), "intent")), ("Repeated decisions", activity.repeated_lines(said))]
    for name, column in (("Outcomes", "outcome"), ("Arcs", "arc")):
        if column in used.columns:
            sections.append((name, activity.mix(used, column).orderBy(F.desc("n"), column)))
    kinds = stack(own, used.select("session_id"))
    sections += [("Extensions", kinds.filter("kind = 'extension'").select("value", "n")), ("Programs", programs(own))]
    if used.select("agent").distinct().limit(2).count() > 1:
        sections.append(("Agents", activity.agent_split(used)))
    return activity.markdown("Digest", sections, truncated)
