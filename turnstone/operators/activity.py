"""Digest, dashboard, prediction and loop detection over sessions and events. Every clock is an explicit as_of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

STUCK_TURNS, STUCK_ERRORS, STUCK_WINDOW = 12, 3, 10
SHARE = 0.02


def in_window(sessions: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Sessions that start within the days before as_of; 0 days is all time. Unknown starts belong to all time only."""
    return sessions if not days else sessions.filter(F.col("start_ts") >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def of_agent(sessions: DataFrame, agent: str | None) -> DataFrame:
    """The sessions of one agent, or of all; those of an unknown agent always show."""
    return sessions if agent is None else sessions.filter(F.col("agent").isNull() | (F.col("agent") == agent))


def stuck(turns: DataFrame, least: int = STUCK_TURNS, errors: int = STUCK_ERRORS, window: int = STUCK_WINDOW) -> DataFrame:
    """(session_id, turns, recent_errors): sessions of enough turns with enough errors among their last ones. turns: seq, is_error."""
    w = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    last = turns.withColumn("back", F.row_number().over(w))
    found = last.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("is_error") & (F.col("back") <= window)).alias("recent_errors"))
    return found.filter((F.col("turns") >= least) & (F.col("recent_errors") >= errors))


def error_history(turns: DataFrame, window: int = STUCK_WINDOW) -> DataFrame:
    """Each turn with the errors among it and the turns before, window in all."""
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(1 - window, 0)
    return turns.withColumn("errors", F.sum(F.col("is_error").cast("bigint")).over(w))


def top(atoms: DataFrame, value: str, n: int, key: str | None = None) -> DataFrame:
    """The n most frequent values (of each key), ties by value."""
    keys = [key] if key else []
    counted = atoms.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    if not key:
        return counted.orderBy(F.desc("n"), value).limit(n)
    w = Window.partitionBy(key).orderBy(F.desc("n"), value)
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def mix(atoms: DataFrame, value: str, least: float = SHARE) -> DataFrame:
    """(value, n, share) of each value that has at least the share of all rows."""
    counted = atoms.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select(value, "n", F.round(F.col("n") / F.col("total"), 6).alias("share")).filter(F.col("share") >= least)


def fingerprint(sessions: DataFrame) -> DataFrame:
    """Mean and upper median of turns, longest session (ties by id), share of sessions with errors; one row. sessions: session_id, turns, has_errors.

    The upper median comes from counts by size, so no list of all sessions is made.
    """
    sizes = sessions.groupBy("turns").agg(F.count(F.lit(1)).alias("n"))
    upto = sizes.withColumn("upto", F.sum("n").over(Window.orderBy("turns")))
    facts = sessions.agg(F.count(F.lit(1)).alias("sessions"), F.round(F.avg("turns"), 6).alias("avg_turns"), F.min_by("session_id", F.struct(-F.col("turns"), "session_id")).alias("longest"), F.round(F.avg(F.col("has_errors").cast("double")), 6).alias("error_rate"))
    median = upto.crossJoin(F.broadcast(facts.select("sessions"))).filter(F.col("upto") > F.floor(F.col("sessions") / 2)).agg(F.min("turns").alias("median_turns"))
    return facts.crossJoin(F.broadcast(median))


def agent_split(sessions: DataFrame) -> DataFrame:
    """By agent: sessions, share, and the most frequent intent (ties by name)."""
    by = sessions.groupBy("agent", "intent").agg(F.count(F.lit(1)).alias("n"))
    agents = by.groupBy("agent").agg(F.sum("n").alias("sessions"), F.min_by("intent", F.struct(-F.col("n"), "intent")).alias("dominant_intent"))
    total = agents.agg(F.sum("sessions").alias("total"))
    return agents.crossJoin(F.broadcast(total)).select("agent", "sessions", F.round(F.col("sessions") / F.col("total"), 6).alias("share"), "dominant_intent")


def repeated_lines(decisions: DataFrame, least: int = 2, most: int = 6) -> DataFrame:
    """Lines (column key) that stand in several sessions: (key, sessions, example), the most spread first, ties by key.

    Hashes of the lines are counted, and the texts are fetched for those alone that are as spread as the last line shown.
    """
    hashed = decisions.select("session_id", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(8), "key").alias("h2"))
    counted = hashed.distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sessions"), F.min("session_id").alias("example")).filter(F.col("sessions") >= least)
    lead = counted.select("sessions").orderBy(F.desc("sessions")).limit(most).agg(F.min("sessions").alias("last"))
    wanted = counted.crossJoin(F.broadcast(lead)).filter(F.col("sessions") >= F.col("last"))
    texts = decisions.select("key", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(8), "key").alias("h2")).join(wanted, ["h1", "h2"])
    return texts.groupBy("h1", "h2").agg(F.min("key").alias("key"), F.first("sessions").alias("sessions"), F.first("example").alias("example")).select("key", "sessions", "example").orderBy(F.desc("sessions"), "key").limit(most)


def kpi(events: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Events, users, errors and active days of the window before as_of and of the equal one before it, with rounded change in percent.

    A change against nothing is null. events: ts, user_id, is_error.
    """
    span = F.expr(f"INTERVAL {days} DAYS")
    now = (F.col("ts") >= as_of - span) & (F.col("ts") < as_of)
    before = (F.col("ts") >= as_of - span - span) & (F.col("ts") < as_of - span)
    day = F.to_date("ts")
    facts = {"events": lambda w: F.count_if(w), "users": lambda w: F.countDistinct(F.when(w, F.col("user_id"))), "errors": lambda w: F.count_if(w & F.col("is_error")), "active_days": lambda w: F.countDistinct(F.when(w, day))}
    row = events.agg(*[f(now).alias(f"{k}_now") for k, f in facts.items()], *[f(before).alias(f"{k}_before") for k, f in facts.items()])
    parts = [F.struct(F.lit(k).alias("metric"), F.col(f"{k}_now").alias("current"), F.col(f"{k}_before").alias("previous")) for k in facts]
    return row.select(F.inline(F.array(*parts))).withColumn("diff", F.col("current") - F.col("previous")).withColumn("pct", F.when(F.col("previous") > 0, F.round(100 * F.col("diff") / F.col("previous"), 0).cast("bigint")))


def streaks(events: DataFrame) -> DataFrame:
    """(user_id, first_day, last_day, days): runs of consecutive active days."""
    days = events.select("user_id", F.to_date("ts").alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    return days.withColumn("island", island).groupBy("user_id", "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days")).drop("island")


def current_streak(events: DataFrame, today: Column) -> DataFrame:
    """(user_id, days): how many days on end up to and with today each user was active; 0 for one who wasn't today. events: user_id, ts."""
    back = F.datediff(today, F.to_date("ts"))
    days = events.select("user_id", back.alias("back")).filter("back >= 0").distinct()
    # The n-th day back is part of the streak if n days lie before it in the list, all of them active.
    placed = days.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("back")) - 1)
    found = placed.groupBy("user_id").agg(F.count_if(F.col("n") == F.col("back")).alias("days"))
    return events.select("user_id").distinct().join(found, "user_id", "left").select("user_id", F.coalesce("days", F.lit(0)).alias("days"))


def tiles(sessions: DataFrame) -> DataFrame:
    """One row: sessions, turns, tools and distinct active days. sessions: start_ts, turns, tools."""
    return sessions.agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"), F.coalesce(F.sum("tools"), F.lit(0)).alias("tools"), F.countDistinct(F.to_date("start_ts")).alias("active_days"))


def week_stats(sessions: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """(metric, current, previous): sessions, turns, tool calls, sessions with errors and distinct projects of those that start in the
    days before as_of, and in as many before. sessions: start_ts, turns, tools, has_errors, project. An unknown project is one too."""
    span = F.expr(f"INTERVAL {days} DAYS")
    week = F.when((F.col("start_ts") >= as_of - span) & (F.col("start_ts") < as_of), "current").when((F.col("start_ts") >= as_of - span - span) & (F.col("start_ts") < as_of - span), "previous")
    own = sessions.withColumn("week", week)
    facts = {"sessions": lambda w: F.count_if(w), "turns": lambda w: F.sum(F.when(w, F.col("turns")).otherwise(0)), "tools": lambda w: F.sum(F.when(w, F.col("tools")).otherwise(0)), "error_sessions": lambda w: F.count_if(w & F.col("has_errors")), "projects": lambda w: F.countDistinct(F.when(w, F.coalesce(F.col("project").cast("string"), F.lit("\0"))))}
    row = own.agg(*[F.coalesce(f(F.col("week") == w), F.lit(0)).cast("bigint").alias(f"{k}_{w}") for k, f in facts.items() for w in ("current", "previous")])
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"{k}_current").alias("current"), F.col(f"{k}_previous").alias("previous")) for k in facts])))


def heatmap(days: DataFrame, first: str, last: str) -> DataFrame:
    """(day, n, level) for each day from first to last; levels 1 to 4 cut at the .25, .55 and .85 order statistics of the active days, 0 without activity."""
    spine = days.sparkSession.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS day")
    full = spine.join(days.select("day", "n"), "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))
    # At most one row a day, so the sorted list of counts is as short as the calendar.
    cuts = full.filter("n > 0").agg(F.array_sort(F.collect_list("n")).alias("s"))
    at = lambda p: F.get(F.col("s"), F.floor(F.size("s") * p).cast("int"))
    level = F.when(F.col("n") == 0, 0).when(F.col("n") <= at(0.25), 1).when(F.col("n") <= at(0.55), 2).when(F.col("n") <= at(0.85), 3).otherwise(4)
    return full.crossJoin(F.broadcast(cuts)).select("day", "n", level.alias("level"))


def bars(rows: DataFrame, field: str, most: int = 8, noun: str = "projects") -> DataFrame:
    """(name, n): the largest groups, and all others as one named for their number; blanks count as (unknown)."""
    name = F.when(F.trim(F.coalesce(F.col(field).cast("string"), F.lit(""))) == "", "(unknown)").otherwise(F.col(field).cast("string"))
    counted = rows.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    lead = counted.orderBy(F.desc("n"), "name").limit(most)
    # Both are a few rows; the rest is found as a difference instead of by ranking all groups in one task.
    rest = counted.join(F.broadcast(lead.select("name")), "name", "left_anti").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n")).filter("groups > 0")
    return lead.unionAll(rest.select(F.concat(F.col("groups").cast("string"), F.lit(f" other {noun}")).alias("name"), "n"))


def rail(sessions: DataFrame) -> DataFrame:
    """Sessions with the label of their relative group on the first of each group (newest first). sessions: session_id, start_ts, group.

    The first of each group is an aggregate, and groups are as few as months, so they are broadcast.
    """
    newest = F.struct(-F.unix_micros(F.col("start_ts").cast("timestamp")), "session_id")
    first = sessions.groupBy(F.col("group").alias("label")).agg(F.min_by("session_id", newest).alias("_first"))
    return sessions.join(F.broadcast(first), (F.col("session_id") == F.col("_first")) & F.col("group").eqNullSafe(F.col("label")), "left").drop("_first")


def cooccurrence(calls: DataFrame) -> DataFrame:
    """(a, b, sessions), a < b: tools used in the same session. Tools are made distinct by session first, so a session gives few pairs."""
    own = calls.groupBy("session_id").agg(F.array_sort(F.collect_set("name")).alias("t"))
    pairs = F.flatten(F.transform("t", lambda a, i: F.transform(F.slice(F.col("t"), i + 2, F.size("t")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return own.select(F.inline(pairs)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("sessions"))


def error_catalogue(errors: DataFrame, size: int = 40, most: int = 20) -> DataFrame:
    """(prefix, n, sessions) of error texts by their first characters."""
    return errors.groupBy(F.left("content", F.lit(size)).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session_id").alias("sessions")).orderBy(F.desc("n"), "prefix").limit(most)


def pivots(turns: DataFrame, anchors: DataFrame) -> DataFrame:
    """(session_id, pivot): the first turn with most occurrences of the anchor words; with fewer than two, two thirds through.

    anchors: word (over four octets). turns: session_id, turn_index, text.
    """
    words = turns.select("session_id", "turn_index", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+")).alias("word")).filter(F.octet_length("word") > 4)
    hits = words.join(anchors.select("word").distinct(), "word", "left_semi").groupBy("session_id", "turn_index").agg(F.count(F.lit(1)).alias("n"))
    best = hits.groupBy("session_id").agg(F.max_by("turn_index", F.struct("n", -F.col("turn_index"))).alias("at"), F.max("n").alias("n"))
    sizes = turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"))
    late = F.least(F.floor(2 * F.col("turns") / 3), F.col("turns") - 1)
    return sizes.join(best, "session_id", "left").select("session_id", F.when(F.coalesce("n", F.lit(0)) < 2, late).otherwise(F.col("at")).cast("bigint").alias("pivot"))


def pivots_by_query(near: DataFrame, turns: DataFrame, anchors: DataFrame) -> DataFrame:
    """(query_id, session_id, pivot): like pivots(), with anchors (query_id, word) of each query's own; near: query_id, session_id."""
    own = turns.join(near.select("session_id").distinct(), "session_id", "left_semi")
    # A row for each word of a session with all its turns, so that a pair of sessions meets once for each anchor, not for each turn.
    words = own.select("session_id", F.col("turn_index").cast("bigint").alias("turn"), F.explode(_long_words("text")).alias("word")).groupBy("session_id", "word").agg(F.collect_list("turn").alias("turns_of"))
    met = near.select("query_id", "session_id").join(anchors.select("query_id", "word").distinct(), "query_id").join(words, ["session_id", "word"])
    # What moves is lists; they come apart again where a pair's lie together. A turn and its number of words are one number, as those are quicker to compare.
    hits = met.groupBy("query_id", "session_id").agg(F.flatten(F.collect_list("turns_of")).alias("turns_of")).select("query_id", "session_id", F.explode("turns_of").alias("turn"))
    counted = hits.groupBy("query_id", "session_id", "turn").agg(F.count(F.lit(1)).alias("n"))
    most = counted.groupBy("query_id", "session_id").agg(F.max(F.shiftleft("n", 32) - F.col("turn")).alias("most")).withColumn("n", F.shiftright(F.col("most") + (2**32 - 1), 32))
    best = most.select("query_id", "session_id", (F.shiftleft("n", 32) - F.col("most")).alias("at"), "n")
    sizes = own.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"))
    late = F.least(F.floor(2 * F.col("turns") / 3), F.col("turns") - 1)
    return near.select("query_id", "session_id").join(sizes, "session_id").join(best, ["query_id", "session_id"], "left").select("query_id", "session_id", F.when(F.coalesce("n", F.lit(0)) < 2, late).otherwise(F.col("at")).cast("bigint").alias("pivot"))


def _long_words(text: str) -> Column:
    """Words of over four octets."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) > 4)


def anchors_of(turns: DataFrame, last: int) -> DataFrame:
    """(query_id, word): the long words of each session's last turns."""
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn_index")))
    return anchor_words(turns.withColumn("back", back).filter(F.col("back") <= last).select(F.col("session_id").alias("query_id"), "text"))


def anchor_words(turns: DataFrame) -> DataFrame:
    """(query_id, word): the long words of turns (query_id, text)."""
    return turns.select("query_id", F.explode(_long_words("text")).alias("word")).distinct()


def predict(neighbours: DataFrame, pivot: DataFrame, calls: DataFrame, horizon: int | Column = 3, most: int = 6) -> DataFrame:
    """The tools that like sessions used next: neighbours (query_id, session_id, score), the calls of their turns pivot+1 to pivot+horizon.
    pivot: by session, or by query and session. horizon: a number, or a column of the neighbours.

    score = 0.55 * share of the calls + 0.45 * mean similarity; example is the most similar session.
    """
    near = neighbours.join(pivot, [c for c in ("query_id", "session_id") if c in pivot.columns])
    # Turns meet by their number, so a session's other calls make no rows.
    after = near.withColumn("turn_index", F.explode(F.sequence((F.col("pivot") + 1).cast("bigint"), (F.col("pivot") + horizon).cast("bigint"))))
    used = after.join(calls.select("session_id", F.col("turn_index").cast("bigint").alias("turn_index"), "name"), ["session_id", "turn_index"])
    by = used.groupBy("query_id", "name").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("confidence"), F.min_by("session_id", F.struct(-F.col("score"), "session_id")).alias("example"))
    total = F.sum("n").over(Window.partitionBy("query_id"))
    scored = by.withColumn("freq", F.round(F.col("n") / total, 6)).withColumn("confidence", F.round("confidence", 6)).withColumn("score", F.round(0.55 * F.col("n") / total + 0.45 * F.col("confidence"), 5))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "name")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("query_id", "name", "freq", "confidence", "score", "example", "rank")


def prompt_days(prompts: DataFrame, zone: str = "UTC") -> DataFrame:
    """(day, n, projects) of prompts by local day; times of zero or less are dropped. prompts: ts_ms (number or text), project."""
    ms = F.expr("try_cast(ts_ms AS BIGINT)")
    ok = prompts.withColumn("ms", ms).filter("ms > 0")
    return ok.groupBy(F.to_date(F.from_utc_timestamp(F.timestamp_millis("ms"), zone)).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.nullif("project", F.lit(""))).alias("projects"))


def markdown(title: str, sections: list[tuple[str, DataFrame]], truncated: bool = False) -> str:
    """A report in the given order of sections, from small tables (each at most 50 rows); empty ones are left out."""
    out = [f"# {title}", ""]
    for name, df in sections:
        rows = df.limit(50).collect()
        if rows:
            out += [f"## {name}", "", *("- " + " · ".join(str(v) for v in r if v is not None) for r in rows), ""]
    if len(out) == 2:
        out.append("Nothing is known here yet.")
    if truncated:
        out.append("_Only the newest sessions were read._")
    return "\n".join(out)
