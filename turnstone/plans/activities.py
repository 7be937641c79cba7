"""Queries over activity: name -> (query, SQL that gives the same rows, or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstone.functions import text as t
from turnstone.operators import activity as a, retrieval
from turnstone.operators import store
from turnstone.plans.adapters import AS_OF_TS, calls, points, queries, table, turns
from turnstone.streaming import watch



def _now():
    return F.expr(AS_OF_TS)



def _events(spark, d):
    return table(spark, d, "events").select("ts", "user_id", "event_id", "event_type", "value", (F.col("event_type") == "error").alias("is_error"))


def _sessions(spark, d):
    """Users as sessions: start, size and whether anything failed."""
    return _events(spark, d).groupBy(F.col("user_id").alias("session_id")).agg(F.min("ts").alias("start_ts"), F.count(F.lit(1)).alias("turns"), F.max("is_error").alias("has_errors"), F.min_by("event_type", F.struct("ts", "event_id")).alias("intent"))


def stuck_sessions(spark, d):
    return a.stuck(calls(spark, d))


def error_window_history(spark, d):
    return a.error_history(calls(spark, d)).filter("is_error").select("session_id", "seq", "errors")


def mix_buckets(spark, d):
    return a.mix(_events(spark, d), "event_type")


def top_tools(spark, d):
    return a.top(calls(spark, d), "name", 2, "session_id")


def fingerprint(spark, d):
    return a.fingerprint(_sessions(spark, d))


def agent_split(spark, d):
    s = _sessions(spark, d).withColumn("agent", F.when(F.col("session_id") % 3 == 0, "codex").otherwise("claude_code"))
    return a.agent_split(s)


def repeated_lines(spark, d):
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("session_id"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).select("session_id", t.dedup_key(F.col("line")).alias("key")).filter("key <> ''")
    return a.repeated_lines(lines)


def kpi_delta(spark, d):
    return a.kpi(_events(spark, d), _now(), 14)


def _visits(spark, d):
    """A user's day as a session."""
    e = _events(spark, d)
    by = e.groupBy("user_id", F.to_date("ts").alias("day"))
    return by.agg(F.min("ts").alias("start_ts"), F.count(F.lit(1)).alias("turns"), F.count_if(F.col("event_type") != "view").alias("tools"), F.max("is_error").alias("has_errors")).withColumn("project", F.nullif(F.col("user_id") % 40, F.lit(0)))


def week_over_week(spark, d):
    return a.week_stats(_visits(spark, d), _now())


def kpi_tiles(spark, d):
    return a.tiles(a.in_window(_visits(spark, d), _now(), 14))


def relative_times(spark, d):
    """How long before the clock each user's first event was, in words, and under which group it stands."""
    first = _events(spark, d).groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    clock = F.expr("TIMESTAMP'2024-01-30 23:58:00'")
    return first.select("user_id", t.relative_ago(F.col("first"), clock).alias("first_ago"), t.relative_ago(F.col("last"), clock).alias("last_ago"), t.relative_group(F.to_date("first"), F.to_date(_now())).alias("first_group"), t.relative_group(F.add_months(F.to_date("first"), -2), F.to_date(_now())).alias("older_group"))


def streak(spark, d):
    """Days on end up to the last day of the table."""
    return a.current_streak(_events(spark, d), F.expr("DATE'2024-01-30'"))


def heatmap_levels(spark, d):
    days = _events(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return a.heatmap(days, "2023-12-25", "2024-02-04")


def project_bars_tail(spark, d):
    return a.bars(table(spark, d, "documents"), "source")


def top_sessions(spark, d):
    return _sessions(spark, d).orderBy(F.desc("turns"), "session_id").limit(8).select("session_id", "turns")


def recent_sessions(spark, d):
    return a.in_window(_sessions(spark, d), _now(), 30).agg(F.count(F.lit(1)).alias("sessions"), F.sum("turns").alias("turns"))


def time_rail(spark, d):
    s = _sessions(spark, d).withColumn("group", t.relative_group(F.to_date("start_ts"), F.to_date(_now())))
    return a.rail(s).filter("label is not null").select("session_id", "label")


def tool_cooccurrence(spark, d):
    return a.cooccurrence(calls(spark, d))


def error_catalogue(spark, d):
    e = calls(spark, d).filter("is_error").select("session_id", F.coalesce("input_json", F.lit("")).alias("content"))
    return a.error_catalogue(e, 12)


def pivot_turn(spark, d):
    """Anchors: the words of every conversation's first turn, as one set of at most the vocabulary."""
    tt = turns(spark, d)
    anchors = tt.filter("turn_index = 0").select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+")).alias("word")).filter(F.octet_length("word") > 4)
    return a.pivots(tt, anchors)


def predict_next(spark, d):
    """What like sessions did after their middle: neighbours among points, whose ids are users."""
    p = points(spark, d)
    near = retrieval.neighbours(p, queries(p), 8).select("query_id", F.col("id").alias("session_id"), "score")
    c = calls(spark, d)
    middle = c.groupBy("session_id").agg(F.expr("count(1) div 2").alias("pivot"))
    return a.predict(near, middle, c.select("session_id", F.col("seq").cast("bigint").alias("turn_index"), "name"))


def prompt_days(spark, d):
    p = _events(spark, d).select(F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("ts_ms"), F.col("event_type").alias("project"))
    return a.prompt_days(p)


def latest_errors(spark, d):
    """Each session's newest error among its last six events."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    return calls(spark, d).withColumn("back", F.row_number().over(w)).filter("back <= 6 and is_error").groupBy("session_id").agg(F.max("seq").alias("seq"), F.max_by("call_id", "seq").alias("event_id"))


def dual_read(spark, d):
    """New rows win over old ones with the same key."""
    p = points(spark, d).select("id", "project")
    return store.dual_read(p.filter("id % 3 = 0").withColumn("version", F.lit(3)), p.withColumn("version", F.lit(2)), "id")


def dedupe_first(spark, d):
    e = _events(spark, d).select(F.col("user_id").alias("session_id"), F.struct("ts", "event_id").alias("scan_order"), "event_id")
    return store.first_of_each(e, "session_id", "scan_order").select("session_id", "event_id")


def conditional_update(spark, d):
    p = points(spark, d).select("id", "project", (F.col("id") % 4).alias("schema_version"))
    return store.update_where(p, [0, 1, 2, 3, 4, 5, 6, 7], 3, {"project": "moved"}).groupBy("project").agg(F.count(F.lit(1)).alias("n"))


def archaeology(spark, d):
    """Old and new sessions: how many, over how many days, and the first and last of them."""
    s = _sessions(spark, d).withColumn("era", F.when(F.col("session_id") % 3 == 0, "legacy").otherwise("modern"))
    return s.groupBy("era").agg(F.count(F.lit(1)).alias("sessions"), F.datediff(F.max("start_ts"), F.min("start_ts")).alias("span_days"), F.min("session_id").alias("first_id"), F.max("session_id").alias("last_id"))


def source_facets(spark, d):
    return retrieval.facets(table(spark, d, "documents"), "source")


def error_runs(spark, d):
    """Runs of a session's errors with less than a day between them."""
    e = _events(spark, d).filter("is_error").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), "is_error")
    return watch.error_bursts(e, "1 day").groupBy("session_id").agg(F.count(F.lit(1)).alias("runs"), F.max("n").alias("longest"))


def hourly_errors(spark, d):
    return _events(spark, d).filter("is_error").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("string").alias("hour"), "n")


def predict_alerts(spark, d):
    """Where the first prediction is frequent and its tool is not among the session's own first three."""
    c = calls(spark, d)
    sizes = c.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"))
    return watch.predict_alerts(predict_next(spark, d), c.filter("seq <= 3").select("session_id", "name"), sizes, least=0.3)


def loop_alerts(spark, d):
    return watch.loop_alerts(a.stuck(calls(spark, d)), predict_next(spark, d))


def primer_alerts(spark, d):
    """Sessions of the query set for which at least two others are alike enough."""
    p = points(spark, d)
    return watch.primer_alerts(retrieval.neighbours(p, queries(p), 8, at_least=0.2))


def recall_alerts(spark, d):
    """Each session's errors, by their text an hour apart at least from the last one let through; over the events as a stream."""
    from turnstone.sources.shared import new_folder

    e = table(spark, d, "events").filter("event_type = 'error'")
    keyed = e.select(watch.recall_key(F.col("user_id"), F.coalesce("props", F.lit(""))).alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    got = watch.replay(keyed, lambda s: watch.debounced(s, "key", watch.RECALL_SECONDS), new_folder(spark, "recall"))
    return got.groupBy("key").agg(F.count(F.lit(1)).alias("alerts"))


def index_batches(spark, d):
    """Batches of 32 points by id; a batch with a point of label 3 whose id is a multiple of 11 fails whole."""
    p = points(spark, d).withColumn("batch", F.floor(F.col("id") / 32))
    return store.batch_report(p, "batch", "project = '3' and id % 11 = 0")


def session_by_point(spark, d):
    """Every session found by its point id among all sessions."""
    s = turns(spark, d).select("session_id").distinct()
    asked = s.filter("session_id % 50 = 0").select(t.uuid5_dns(F.col("session_id").cast("string")).alias("point_id"))
    return store.by_point_id(s, asked).select("session_id", "point_id")


def project_sessions(spark, d):
    """The sessions of one project path, and of another that was indexed a minute ago: none."""
    s = points(spark, d).select(F.col("id").alias("session_id"), F.concat(F.lit("/srv/p"), "project").alias("project_path"))
    indexed = spark.sql(f"SELECT '/srv/p2' AS project_path, {AS_OF_TS} - INTERVAL 60 SECONDS AS at UNION ALL SELECT '/srv/p1', {AS_OF_TS} - INTERVAL 90 SECONDS")
    return store.of_project(s, "/srv/p1", indexed, _now()).unionByName(store.of_project(s, "/srv/p2", indexed, _now()))


def collection_info(spark, d):
    return store.info(points(spark, d), "project")


def agent_filter(spark, d):
    """Sessions by agent as each choice of agents shows them; sessions of an unknown agent always show."""
    s = _sessions(spark, d).withColumn("agent", F.when(F.col("session_id") % 3 == 0, "codex").when(F.col("session_id") % 3 == 1, "claude_code"))
    shown = [a.of_agent(s, x).groupBy(F.lit(x or "both").alias("choice"), "agent").agg(F.count(F.lit(1)).alias("n")) for x in (None, "codex", "claude_code")]
    return shown[0].unionAll(shown[1]).unionAll(shown[2])


def title_tokens(spark, d):
    """Documents whose first line, as a title, has both words among its identifier tokens, whatever their case."""
    title = F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1)
    return table(spark, d, "documents").filter(t.has_title_tokens(title, F.lit("OF The"))).select("doc_id")


_EV = "SELECT ts, user_id, event_id, event_type, event_type = 'error' AS is_error FROM events"
_CALLS = "c AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS seq, event_type AS name, event_type = 'error' AS is_error, event_id, props FROM events)"
_SESS = "s AS (SELECT user_id AS session_id, min(ts) AS start_ts, count(*) AS turns, max((event_type = 'error')::INT) AS has_errors, arg_min(event_type, struct_pack(a := ts, b := event_id)) AS intent FROM events GROUP BY ALL)"


def _kpi(days: int) -> str:
    now = f"ts >= {AS_OF_TS} - INTERVAL {days} DAYS AND ts < {AS_OF_TS}"
    before = f"ts >= {AS_OF_TS} - INTERVAL {2 * days} DAYS AND ts < {AS_OF_TS} - INTERVAL {days} DAYS"
    one = lambda name, x, extra="": f"SELECT '{name}' AS metric, (SELECT {x} FROM e WHERE {now}{extra}) AS current, (SELECT {x} FROM e WHERE {before}{extra}) AS previous"
    return f"WITH e AS ({_EV}), m AS ({one('events', 'count(*)')} UNION ALL {one('users', 'count(DISTINCT user_id)')} UNION ALL {one('errors', 'count(*)', ' AND is_error')} UNION ALL {one('active_days', 'count(DISTINCT ts::DATE)')}) SELECT *, current - previous AS diff, CASE WHEN previous > 0 THEN round(100.0 * (current - previous) / previous, 0)::BIGINT END AS pct FROM m"


_VISITS = "WITH v AS (SELECT user_id, min(ts) AS start_ts, count(*) AS turns, count(*) FILTER (event_type <> 'view') AS tools, bool_or(event_type = 'error') AS has_errors, coalesce(nullif(user_id % 40, 0)::VARCHAR, 'none') AS project FROM events GROUP BY user_id, ts::DATE)"
_AGO = "CASE WHEN {0} < 60 THEN {0} || 's ago' WHEN {0} < 3600 THEN {0} // 60 || 'm ago' WHEN {0} < 86400 THEN {0} // 3600 || 'h ago' WHEN {0} // 86400 < 30 THEN {0} // 86400 || 'd ago' WHEN {0} // 86400 // 7 < 12 THEN {0} // 86400 // 7 || 'w ago' ELSE {0} // 86400 // 30 || 'mo ago' END"
_GROUP = "CASE WHEN {0} <= 0 THEN 'Today' WHEN {0} = 1 THEN 'Yesterday' WHEN {0} < 7 THEN {0} || ' days ago' WHEN {0} < 14 THEN 'Last week' WHEN {0} < 30 THEN ({0} // 7) || 'w ago' WHEN year({1}) = 2024 THEN strftime({1}, '%b') ELSE strftime({1}, '%b %y') END"
_P = "p AS (SELECT vec_id AS id, label::VARCHAR AS project FROM embeddings)"
QUERIES: dict[str, tuple] = {
    "stuck_sessions": (stuck_sessions, f"WITH {_CALLS}, b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS back FROM c) SELECT session_id, count(*) AS turns, count(*) FILTER (is_error AND back <= 10) AS recent_errors FROM b GROUP BY ALL HAVING count(*) >= 12 AND count(*) FILTER (is_error AND back <= 10) >= 3"),
    "error_window_history": (error_window_history, f"WITH {_CALLS}, h AS (SELECT *, sum(is_error::INT) OVER (PARTITION BY session_id ORDER BY seq ROWS 9 PRECEDING)::BIGINT AS errors FROM c) SELECT session_id, seq, errors FROM h WHERE is_error"),
    "mix_buckets": (mix_buckets, "SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY ALL HAVING share >= 0.02"),
    "top_tools": (top_tools, "WITH g AS (SELECT user_id AS session_id, event_type AS name, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, name)::INT AS rank FROM g) SELECT * FROM r WHERE rank <= 2"),
    "fingerprint": (fingerprint, f"WITH {_SESS} SELECT count(*) AS sessions, round(avg(turns), 6) AS avg_turns, arg_max(session_id, struct_pack(a := turns, b := -session_id)) AS longest, round(avg(has_errors), 6) AS error_rate, (list_sort(list(turns)))[count(*) // 2 + 1] AS median_turns FROM s"),
    "agent_split": (agent_split, f"WITH {_SESS}, g AS (SELECT CASE WHEN session_id % 3 = 0 THEN 'codex' ELSE 'claude_code' END AS agent, intent, count(*) AS n FROM s GROUP BY ALL) SELECT agent, sum(n)::BIGINT AS sessions, round(sum(n) / (SELECT sum(n) FROM g), 6) AS share, arg_min(intent, struct_pack(a := -n, b := intent)) AS dominant_intent FROM g GROUP BY ALL"),
    "repeated_lines": (repeated_lines, "WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents), k AS (SELECT doc_id, left(trim(regexp_replace(lower(regexp_replace(x, '^[-*+•·→↪↵#>\\s]+', '')), '\\s+', ' ', 'g'), ' '), 120) AS key FROM l) SELECT key, count(DISTINCT doc_id) AS sessions, min(doc_id) AS example FROM k WHERE key <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2 ORDER BY sessions DESC, key LIMIT 6"),
    "kpi_delta": (kpi_delta, _kpi(14)),
    "week_over_week": (week_over_week, f"{_VISITS}, x AS (SELECT *, CASE WHEN start_ts >= {AS_OF_TS} - INTERVAL 7 DAYS AND start_ts < {AS_OF_TS} THEN 1 WHEN start_ts >= {AS_OF_TS} - INTERVAL 14 DAYS AND start_ts < {AS_OF_TS} - INTERVAL 7 DAYS THEN 2 END AS w FROM v) " + " UNION ALL ".join(f"SELECT '{m}' AS metric, coalesce({e.format(1)}, 0)::BIGINT AS current, coalesce({e.format(2)}, 0)::BIGINT AS previous FROM x" for m, e in (("sessions", "count(*) FILTER (w = {})"), ("turns", "sum(turns) FILTER (w = {})"), ("tools", "sum(tools) FILTER (w = {})"), ("error_sessions", "count(*) FILTER (w = {} AND has_errors)"), ("projects", "count(DISTINCT project) FILTER (w = {})")))),
    "kpi_tiles": (kpi_tiles, f"{_VISITS} SELECT count(*) AS sessions, sum(turns)::BIGINT AS turns, sum(tools)::BIGINT AS tools, count(DISTINCT start_ts::DATE) AS active_days FROM v WHERE start_ts >= {AS_OF_TS} - INTERVAL 14 DAYS"),
    "relative_times": (relative_times, f"WITH f AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY ALL), s AS (SELECT *, (epoch_us(TIMESTAMP '2024-01-30 23:58:00') - epoch_us(a)) // 1000000 AS sa, floor((epoch_us(TIMESTAMP '2024-01-30 23:58:00') - epoch_us(b)) / 1000000)::BIGINT AS sb, date_diff('day', a::DATE, DATE '2024-01-31') AS da, (a::DATE - INTERVAL 2 MONTHS)::DATE AS o FROM f) SELECT user_id, {_AGO.format('sa')} AS first_ago, {_AGO.format('sb')} AS last_ago, {_GROUP.format('da', 'a')} AS first_group, {_GROUP.format("date_diff('day', o, DATE '2024-01-31')", 'o')} AS older_group FROM s"),
    "streak": (streak, "WITH RECURSIVE d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), r AS (SELECT user_id, day FROM d WHERE day = DATE '2024-01-30' UNION ALL SELECT d.user_id, d.day FROM r JOIN d ON d.user_id = r.user_id AND d.day = r.day - 1) SELECT u.user_id, count(r.day) AS days FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN r ON r.user_id = u.user_id GROUP BY u.user_id"),
    "heatmap_levels": (heatmap_levels, "WITH d AS (SELECT unnest(generate_series(DATE '2023-12-25', DATE '2024-02-04', INTERVAL 1 DAY))::DATE AS day), c AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL), f AS (SELECT d.day, coalesce(n, 0) AS n FROM d LEFT JOIN c ON d.day = c.day), s AS (SELECT list_sort(list(n)) AS s FROM f WHERE n > 0) SELECT day, n, CASE WHEN n = 0 THEN 0 WHEN n <= s[floor(len(s) * 0.25)::INT + 1] THEN 1 WHEN n <= s[floor(len(s) * 0.55)::INT + 1] THEN 2 WHEN n <= s[floor(len(s) * 0.85)::INT + 1] THEN 3 ELSE 4 END AS level FROM f, s"),
    "project_bars_tail": (project_bars_tail, "WITH g AS (SELECT CASE WHEN trim(coalesce(source, '')) = '' THEN '(unknown)' ELSE source END AS name, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, name) AS k FROM g) SELECT name, n FROM r WHERE k <= 8 UNION ALL SELECT count(*) || ' other projects', sum(n)::BIGINT FROM r WHERE k > 8 HAVING count(*) > 0"),
    "top_sessions": (top_sessions, f"WITH {_SESS} SELECT session_id, turns FROM s ORDER BY turns DESC, session_id LIMIT 8"),
    "recent_sessions": (recent_sessions, f"WITH {_SESS} SELECT count(*) AS sessions, sum(turns)::BIGINT AS turns FROM s WHERE start_ts >= {AS_OF_TS} - INTERVAL 30 DAYS"),
    "time_rail": (time_rail, f"WITH {_SESS}, g AS (SELECT *, date_diff('day', start_ts::DATE, DATE '2024-01-31') AS d FROM s), l AS (SELECT *, CASE WHEN d <= 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' WHEN d < 7 THEN d || ' days ago' WHEN d < 14 THEN 'Last week' WHEN d < 30 THEN (d // 7) || 'w ago' WHEN year(start_ts) = 2024 THEN strftime(start_ts, '%b') ELSE strftime(start_ts, '%b %y') END AS label FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY start_ts DESC, session_id) AS k FROM l) SELECT session_id, label FROM r WHERE k = 1"),
    "tool_cooccurrence": (tool_cooccurrence, "WITH u AS (SELECT DISTINCT user_id, event_type AS t FROM events WHERE event_type IS NOT NULL) SELECT x.t AS a, y.t AS b, count(*) AS sessions FROM u x JOIN u y ON x.user_id = y.user_id AND x.t < y.t GROUP BY ALL"),
    "error_catalogue": (error_catalogue, "SELECT left(coalesce(props, ''), 12) AS prefix, count(*) AS n, count(DISTINCT user_id) AS sessions FROM events WHERE event_type = 'error' GROUP BY ALL ORDER BY n DESC, prefix LIMIT 20"),
    "pivot_turn": (pivot_turn, "WITH w AS (SELECT conv_id, turn, unnest(string_split_regex(lower(coalesce(text, '')), '[^\\pL\\pN]+')) AS w FROM conversations), an AS (SELECT DISTINCT w FROM w WHERE turn = 0 AND strlen(w) > 4), h AS (SELECT conv_id, turn, count(*) AS n FROM w WHERE w IN (SELECT w FROM an) GROUP BY ALL), b AS (SELECT conv_id, arg_max(turn, struct_pack(a := n, b := -turn)) AS best_at, max(n) AS n FROM h GROUP BY ALL), z AS (SELECT conv_id, count(*) AS t FROM conversations GROUP BY ALL) SELECT z.conv_id AS session_id, (CASE WHEN coalesce(n, 0) < 2 THEN least(floor(2 * t / 3), t - 1) ELSE best_at END)::BIGINT AS \"pivot\" FROM z LEFT JOIN b ON z.conv_id = b.conv_id"),
    "predict_next": (predict_next, f"WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS id, round(list_dot_product(embedding::DOUBLE[], qv), 6) AS score FROM embeddings, q WHERE vec_id <> query_id), n AS (SELECT query_id, id AS session_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s) WHERE k <= 8), {_CALLS}, m AS (SELECT session_id, count(*) // 2 AS mid FROM c GROUP BY ALL), u AS (SELECT n.query_id, c.name, n.score, n.session_id FROM n JOIN m ON n.session_id = m.session_id JOIN c ON c.session_id = n.session_id AND c.seq > mid AND c.seq <= mid + 3), g AS (SELECT query_id, name, count(*) AS n, round(avg(score), 6) AS confidence, arg_max(session_id, struct_pack(a := score, b := -session_id)) AS example FROM u GROUP BY ALL), f AS (SELECT *, sum(n) OVER (PARTITION BY query_id) AS total FROM g), o AS (SELECT query_id, name, round(n / total, 6) AS freq, confidence, round(0.55 * n / total + 0.45 * confidence, 5) AS score, example FROM f) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name)::INT AS rank FROM o) WHERE rank <= 6"),
    "agent_filter": (agent_filter, f"WITH {_SESS}, g AS (SELECT CASE session_id % 3 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude_code' END AS agent FROM s), c AS (SELECT unnest(['both', 'codex', 'claude_code']) AS choice) SELECT choice, agent, count(*) AS n FROM c, g WHERE choice = 'both' OR agent IS NULL OR agent = choice GROUP BY ALL"),
    "title_tokens": (title_tokens, f"WITH w AS (SELECT doc_id, unnest(string_split_regex(string_split(coalesce(text, ''), chr(10))[1], '[{t.WHITE}]+')) AS w FROM documents), p AS (SELECT doc_id, unnest(list_concat([w], string_split_regex(w, '[_-]'))) AS p FROM w), c AS (SELECT doc_id, unnest(list_concat([p], string_split(regexp_replace(p, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), ' '))) AS p FROM p) SELECT doc_id FROM c WHERE length(p) > 1 GROUP BY doc_id HAVING bool_or(lower(p) = 'of') AND bool_or(lower(p) = 'the')"),
    "index_batches": (index_batches, f"WITH {_P}, b AS (SELECT id // 32 AS batch, project = '3' AND id % 11 = 0 AS bad FROM p) SELECT batch, CASE WHEN bool_or(bad) THEN 0 ELSE count(*) END AS indexed, CASE WHEN bool_or(bad) THEN count(*) ELSE 0 END AS errors FROM b GROUP BY ALL"),
    "session_by_point": (session_by_point, "WITH s AS (SELECT DISTINCT conv_id AS session_id FROM conversations WHERE conv_id % 50 = 0), h AS (SELECT session_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || session_id::VARCHAR::BLOB) AS r FROM s) SELECT session_id, substr(r, 1, 8) || '-' || substr(r, 9, 4) || '-5' || substr(r, 14, 3) || '-' || substr('89ab', ('0x' || substr(r, 17, 1))::INT % 4 + 1, 1) || substr(r, 18, 3) || '-' || substr(r, 21, 12) AS point_id FROM h"),
    "project_sessions": (project_sessions, "SELECT vec_id AS session_id, '/srv/p1' AS project_path FROM embeddings WHERE label = 1"),
    "collection_info": (collection_info, "SELECT label::VARCHAR AS name, count(*) AS n FROM embeddings GROUP BY ALL UNION ALL SELECT NULL, count(*) FROM embeddings"),
    "primer_alerts": (primer_alerts, "WITH s AS (SELECT q.vec_id AS query_id, p.vec_id AS id, round(list_dot_product(p.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings p, embeddings q WHERE q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s WHERE score >= 0.2) SELECT query_id, count(*) AS sources FROM r WHERE k <= 8 GROUP BY ALL HAVING count(*) >= 2"),
    "recall_alerts": (recall_alerts, "WITH RECURSIVE e AS (SELECT user_id || '|' || left(coalesce(props, ''), 120) AS key, ts FROM events WHERE event_type = 'error'), a AS (SELECT key, min(ts) AS ts FROM e GROUP BY ALL UNION ALL SELECT * FROM (SELECT a.key, min(e.ts) AS ts FROM a JOIN e ON e.key = a.key AND e.ts >= a.ts + INTERVAL 60 MINUTES GROUP BY ALL)) SELECT key, count(*) AS alerts FROM a GROUP BY ALL"),
    "prompt_days": (prompt_days, "SELECT ts::DATE AS day, count(*) AS n, count(DISTINCT event_type) AS projects FROM events GROUP BY ALL"),
    "latest_errors": (latest_errors, f"WITH {_CALLS}, b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS back FROM c) SELECT session_id, max(seq) AS seq, arg_max(event_id, seq) AS event_id FROM b WHERE back <= 6 AND is_error GROUP BY ALL"),
    "dual_read": (dual_read, f"WITH {_P} SELECT id, project, CASE WHEN id % 3 = 0 THEN 3 ELSE 2 END AS version FROM p"),
    "dedupe_first": (dedupe_first, "SELECT user_id AS session_id, arg_min(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events GROUP BY ALL"),
    "conditional_update": (conditional_update, f"WITH {_P} SELECT CASE WHEN id < 8 AND id % 4 < 3 THEN 'moved' ELSE project END AS project, count(*) AS n FROM p GROUP BY 1"),
    "archaeology": (archaeology, f"WITH {_SESS} SELECT CASE WHEN session_id % 3 = 0 THEN 'legacy' ELSE 'modern' END AS era, count(*) AS sessions, date_diff('day', min(start_ts)::DATE, max(start_ts)::DATE)::INT AS span_days, min(session_id) AS first_id, max(session_id) AS last_id FROM s GROUP BY 1"),
    "source_facets": (source_facets, "SELECT source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL AND source <> '' GROUP BY ALL ORDER BY n DESC, value LIMIT 256"),
    "error_runs": (error_runs, "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events WHERE event_type = 'error'), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e), g AS (SELECT user_id, run, count(*) AS n FROM r GROUP BY ALL) SELECT user_id AS session_id, count(*) AS runs, max(n) AS longest FROM g GROUP BY ALL"),
    "hourly_errors": (hourly_errors, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL"),
}
_PREDICTED, _STUCK = QUERIES["predict_next"][1], QUERIES["stuck_sessions"][1]
QUERIES["loop_alerts"] = (loop_alerts, f"SELECT st.session_id, recent_errors, name AS next_tool, freq FROM ({_STUCK}) st LEFT JOIN (SELECT * FROM ({_PREDICTED}) WHERE rank = 1) pr ON st.session_id = pr.query_id")
QUERIES["predict_alerts"] = (predict_alerts, f"WITH {_CALLS}, z AS (SELECT session_id FROM c GROUP BY ALL HAVING count(*) >= 3) SELECT query_id, name, freq FROM ({_PREDICTED}) pr WHERE rank = 1 AND freq > 0.3 AND query_id IN (SELECT session_id FROM z) AND NOT EXISTS (SELECT 1 FROM c WHERE c.session_id = pr.query_id AND seq <= 3 AND lower(c.name) = lower(pr.name))")
