"""Queries over texts and sessions: name -> (query, SQL that gives the same rows, or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnstone.functions import text as t
from turnstone.operators import enrich
from turnstone.plans.adapters import calls, table, turns



def _txt():
    return F.coalesce("text", F.lit(""))



def tokenize_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(t.sparse_tokens(_txt())).alias("tokens"), F.size(F.array_distinct(t.sparse_tokens(_txt()))).alias("distinct_tokens"))


def fnv_postings(spark, d):
    """Sparse vectors of all conversations: counts by hashed token; colliding tokens add."""
    own = turns(spark, d).select("session_id", F.explode(t.sparse_tokens(_txt())).alias("token"))
    counted = own.groupBy("session_id", "token").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("session_id", t.fnv1a31(F.col("token")).alias("token_id")).agg(F.sum("n").alias("tf"))


def _wide():
    """Texts with other kinds of white space around a word."""
    return F.replace(_txt(), F.lit("and"), F.lit("\u00a0and\u3000"))


def chunk_windows(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(t.chunks(_wide(), most=None)).alias("chunk_idx", "chunk")).select("doc_id", "chunk_idx", F.md5(F.encode("chunk", "UTF-8")).alias("chunk_md5"))


def identifier_tokens(spark, d):
    """Of names in several styles, and of each document's first line."""
    name = F.concat(F.lit("get"), F.initcap("lang"), F.lit("Data_fromCache "), "source", F.lit("-"), "lang", F.lit("/x.rs "), F.element_at(F.split(_txt(), "\n"), 1))
    return table(spark, d, "documents").select("doc_id", F.array_join(t.identifier_tokens(name), " ").alias("tokens"))


def synth_title(spark, d):
    """A title for every conversation: its first user turn that isn't noise, else its first user turn with text."""
    u = turns(spark, d).filter("role = 'user'").filter(F.btrim("text") != "")
    w = u.groupBy("session_id").agg(F.min_by("text", F.when(~t.is_noise(F.col("text")), F.col("turn_index"))).alias("a"), F.min_by("text", "turn_index").alias("b"))
    return w.select("session_id", t.title_of(F.coalesce("a", "b")).alias("title"))


def strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(F.encode(t.squeeze(t.strip_tags(F.coalesce("html", F.lit("")))), "UTF-8")).alias("plain_md5"))


def redact(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.encode(t.redact(_txt(), cap=None), "UTF-8")).alias("redacted_md5"))


def clip_dedupe_key(spark, d):
    """Openings of documents that share a dedup key."""
    k = table(spark, d, "documents").select(t.dedup_key(_wide()).alias("key"), "doc_id")
    return k.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1").select(t.truncate(F.col("key"), 40).alias("short_key"), "n", "first_id")


def point_ids(spark, d):
    return turns(spark, d).select("session_id").distinct().select("session_id", t.uuid5_dns(F.col("session_id").cast("string")).alias("point_id"), t.short_id(F.md5(F.col("session_id").cast("string"))).alias("short"))


def url_buckets(spark, d):
    path = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-z]+:/", "")
    return table(spark, d, "pages").groupBy(t.bucket_path(path).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _built(tt: DataFrame) -> DataFrame:
    """Content text of each session: its user and assistant turns, in order, each turn one line. A session is one document."""
    part = F.when(F.btrim(_txt()) != "", F.concat(F.when(F.col("role") == "user", "U: ").otherwise("A: "), "text", F.lit("\n"))).otherwise("")
    kept = tt.filter("role in ('user', 'assistant')").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn_index", part.alias("part")))).alias("parts"))
    return kept.select("session_id", F.array_join(F.transform("parts", lambda s: s["part"]), "").alias("content"))


def content_extract(spark, d):
    """Redacted before it is cut."""
    return _built(turns(spark, d)).select("session_id", F.md5(F.encode(F.left(t.redact(F.col("content")), F.lit(6000)), "UTF-8")).alias("content_md5"))


def error_extract(spark, d):
    tt = turns(spark, d).filter("role = 'assistant'").select("session_id", "turn_index", F.explode(t.error_lines(_txt())).alias("line"))
    return tt.groupBy("session_id").agg(F.count(F.lit(1)).alias("lines"))


def code_extract(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1)).alias("parts"))
    return p.select("page_id", F.size("parts").alias("parts"), F.md5(F.encode(F.array_join("parts", "\n---\n"), "UTF-8")).alias("parts_md5"))


def intent(spark, d):
    return enrich.intent(calls(spark, d), ["click"], ["purchase", "signup"], ["view"], 0.21)


def outcome(spark, d):
    return enrich.outcome(turns(spark, d))


def arc(spark, d):
    c = calls(spark, d)
    return enrich.arc(c, c.select("session_id", "seq", "call_id", "is_error", F.lit("").alias("content")), ["click", "error"], ["purchase"], ["view"])


def last_call_ok(spark, d):
    c = calls(spark, d)
    return enrich.last_shell_ok(c, c.select("session_id", "seq", "call_id", "is_error", F.col("input_json").alias("content")), ["click", "error"])


def entities(spark, d):
    p = table(spark, d, "pages")
    return enrich.entities(p.select(F.col("page_id").alias("session_id"), F.coalesce("url", F.lit("")).alias("text"))).select("session_id", F.array_join("entities", " ").alias("entities"))


def topics(spark, d):
    first = turns(spark, d).filter("role = 'user'").groupBy("session_id").agg(F.min_by("text", "turn_index").alias("text"))
    return first.select("session_id", enrich.topic(F.lit(None).cast("string"), F.lit("talk"), F.coalesce("text", F.lit(""))).alias("topic"))


def _deciding(spark, d):
    """Turns as they are, but every third one opens with a header of a decision made of its words, and every third with a phrase."""
    n, words = F.col("turn_index") % 3, F.regexp_replace(F.left(_txt(), F.lit(30)), r"[^A-Za-z ]", "")
    head = F.when(n == 0, F.concat(F.lit("Decision: use "), words, F.lit("\n"))).when(n == 1, F.concat(F.lit("I'll use "), words, F.lit("\n"))).otherwise(F.lit(""))
    return turns(spark, d).select("session_id", "turn_index", "role", F.concat(head, _txt()).alias("text"))


def decision_lines(spark, d):
    """Lines with a decision's form in all turns; by session."""
    own = _deciding(spark, d).select("session_id", F.explode(t.decisions(F.col("text"))).alias("x"))
    return own.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max("x.confidence").alias("best"), F.count_if(F.col("x.confidence") > 0.8).alias("headers"))


def opening_lines(spark, d):
    """The first line of each conversation that means something, behind a reminder and a note that do not."""
    first = turns(spark, d).filter("role = 'user'").groupBy("session_id").agg(F.min_by("text", "turn_index").alias("text"))
    return first.select("session_id", t.meaningful_line(F.concat(F.lit("<system-reminder>\nbe kind\n</system-reminder>\nNote: none\n"), _txt())).alias("line"))


def session_summary(spark, d):
    """The newest thirty conversations by id, with their counts."""
    s = turns(spark, d).groupBy("session_id").agg(F.count_if(F.col("role") == "user").alias("user_turns"), F.count_if(F.col("role") == "assistant").alias("assistant_turns"), F.count_if(F.col("role") == "system").alias("system_events"), F.sum(F.length(_txt())).alias("chars"))
    return s.orderBy(F.desc("session_id")).limit(30)


def turn_lookup(spark, d):
    """The third turn of every conversation."""
    return turns(spark, d).filter("turn_index = 2").select("session_id", "role", F.md5(F.encode(_txt(), "UTF-8")).alias("text_md5"))


def _marked():
    """Texts with control tags, fences and terminal colours in them."""
    out = F.replace(_txt(), F.lit("the "), F.lit("<invoke name> ``` \x1b[1;31mred\x1b[0m "))
    return F.replace(F.replace(out, F.lit("and "), F.lit("</system-reminder> ~~~ <div> ")), F.lit("of "), F.lit("<parameter \x1b[2K"))


def defanged(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.encode(t.defang(_marked()), "UTF-8")).alias("defanged_md5"))


def plain_terminal(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.encode(t.strip_ansi(_marked()), "UTF-8")).alias("plain_md5"))


def summary_lines(spark, d):
    """A line of fixed widths for each document as a session; every fifth has no project, every seventh no title."""
    project = F.when(F.col("doc_id") % 5 != 0, F.concat_ws("/", "source", "lang", F.lit("some-long-project-name")))
    title = F.when(F.col("doc_id") % 7 != 0, F.element_at(F.split(_txt(), "\n"), 1))
    return table(spark, d, "documents").select("doc_id", t.summary_line(F.md5(F.col("doc_id").cast("string")), project, F.col("n_chars") % 1000, F.col("doc_id") % 90, title).alias("line"))


def hook_outputs(spark, d):
    """What hooks print for each first line, by kind of hook; nothing for a blank one."""
    said = F.concat(F.element_at(F.split(_marked(), "\n"), 1), F.when(F.col("doc_id") % 3 == 0, '\n "quoted" \\ ').otherwise(""))
    said = F.when(F.col("doc_id") % 11 == 0, " \n ").otherwise(said)
    return table(spark, d, "documents").select("doc_id", F.md5(F.encode(t.hook_output("UserPromptSubmit", said), "UTF-8")).alias("hook_md5"), F.md5(F.encode(t.hook_output("Shell", said), "UTF-8")).alias("shell_md5"))


def response_errors(spark, d):
    """Whether each event, as a tool's response of one of six shapes, tells of an error."""
    n = F.col("event_id") % 6
    bad = F.col("event_type") == "error"
    body = F.when(n == 0, F.to_json(F.struct(F.struct(bad.alias("is_error")).alias("tool_response")))).when(n == 1, F.to_json(F.struct(F.struct((F.col("user_id") % 3).alias("exit_code")).alias("tool_response"))))
    body = body.when(n == 2, F.to_json(F.struct(F.when(bad, "Traceback (most)").otherwise("fine").alias("tool_response")))).when(n == 3, F.when(bad, '{"tool_response": {"error": "none given"}}').otherwise('{"tool_response": {"error": null, "out": "ok"}}'))
    body = body.when(n == 4, F.when(bad, '{"tool_response": {"log": ["Fatal: disk"]}}').otherwise('{"other": "fatal: disk"}')).otherwise("not json")
    return table(spark, d, "events").select("event_id", body.alias("body")).select("event_id", t.response_is_error(F.col("body")).alias("is_error"))


_T = "coalesce(text, '')"
_TOK = f"list_filter(string_split_regex(lower({_T}), '[^\\pL\\pN]+'), lambda t: strlen(t) >= 2)"
_FNV = "list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, strlen(token) + 1), lambda i: ('0x' || substr(hex(token), 2 * i - 1, 2))::INTEGER::HUGEINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296) % 2147483648"
_SQ = lambda x: f"trim(regexp_replace({x}, '[{t.WHITE}]+', ' ', 'g'), ' ')"
_WIDE = f"replace({_T}, 'and', chr(160) || 'and' || chr(12288))"
_W = f"list_filter(string_split_regex({_WIDE}, '[{t.WHITE}]+'), lambda w: w <> '')"
_MARKED = f"replace(replace(replace({_T}, 'the ', '<invoke name> ``` ' || chr(27) || '[1;31mred' || chr(27) || '[0m '), 'and ', '</system-reminder> ~~~ <div> '), 'of ', '<parameter ' || chr(27) || '[2K')"
_DEFANG = lambda x: "replace(replace(replace(replace(replace(" + x + ", '```', chr(39) || chr(39) || '`'), '~~~', chr(39) || chr(39) || '~'), '<invoke', '&lt;invoke'), '</system-reminder', '&lt;/system-reminder'), '<parameter', '&lt;parameter')"
_NO_ANSI = lambda x: f"regexp_replace({x}, '\\x1B\\[[0-9;?]*[ -/]*[@-~]', '', 'g')"
_HOOKS = f"""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN ' ' || chr(10) || ' ' ELSE string_split({_MARKED}, chr(10))[1] || CASE WHEN doc_id % 3 = 0 THEN chr(10) || ' "quoted" ' || chr(92) || ' ' ELSE '' END END AS s FROM documents), b AS (SELECT doc_id, {_DEFANG("trim(s, ' ' || chr(9) || chr(10) || chr(13))")} AS b FROM s)
SELECT doc_id, CASE WHEN b <> '' THEN md5('{{"hookSpecificOutput":{{"hookEventName":"UserPromptSubmit","additionalContext":' || to_json(b)::VARCHAR || '}}}}') END AS hook_md5, CASE WHEN b <> '' THEN md5({_NO_ANSI('b')}) END AS shell_md5 FROM b"""
_LASTPOS = lambda words: "greatest(" + ", ".join(f"CASE WHEN contains(l, '{w}') THEN length(l) - strpos(reverse(l), '{w[::-1]}') - {len(w)} + 2 ELSE 0 END" for w in words) + ")"



def _redact_sql(x: str, cap: int | None = t.REDACT_CAP) -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    out = x
    for pattern, name in t.SECRETS:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(f'«redacted:{name}»' if name else chr(92) + '1=«redacted:secret»')}, 'g')"
    scan = f"regexp_matches({x}, {quoted(t.SECRET_MARKS)})"
    if cap is None:
        return f"CASE WHEN {scan} THEN {out} ELSE {x} END"
    out = f"CASE WHEN {scan} OR strlen({x}) > {cap} THEN {out} ELSE {x} END"
    return f"CASE WHEN length({out}) > {cap} THEN left({out}, {cap}) || ' …«truncated»' ELSE {out} END"


_CONTENT = f"WITH c AS (SELECT conv_id AS session_id, coalesce(string_agg(CASE WHEN trim({_T}, ' ') <> '' THEN CASE WHEN role = 'user' THEN 'U: ' ELSE 'A: ' END || text || chr(10) ELSE '' END, '' ORDER BY turn), '') AS content FROM conversations WHERE role IN ('user', 'assistant') GROUP BY ALL)"
def _boilerplate_sql(x: str) -> str:
    starts = " OR ".join(f"starts_with(lower(left(ltrim({x}, ' '), 80)), '{p}')" for p in t.BOILERPLATE)
    return f"(trim({x}, ' ') = '' OR regexp_matches({x}, '^\\s*<[^\\n]*>') OR regexp_matches({x}, '^\\s*[⏸⏵●⏺⎘⤷]') OR {starts})"


_WORDS = f"regexp_replace(left({_T}, 30), '[^A-Za-z ]', '', 'g')"
_DECIDING = f"WITH l AS (SELECT conv_id, unnest(string_split(CASE turn % 3 WHEN 0 THEN 'Decision: use ' || {_WORDS} || chr(10) WHEN 1 THEN 'I''ll use ' || {_WORDS} || chr(10) ELSE '' END || {_T}, chr(10))) AS raw FROM conversations), x AS (SELECT conv_id, trim(raw, ' ') AS x FROM l)"
_HEADER_SQL, _PHRASE_SQL, _REJECTED_SQL = (p.replace("'", "''") for p in (t.DECISION_HEADER, t.DECISION_PHRASE, t.REJECTED))
_DECIDED = f"d AS (SELECT conv_id, 0.9 AS c FROM x WHERE regexp_matches(x, '{_HEADER_SQL}') UNION ALL SELECT conv_id, 0.7 FROM x WHERE strlen(x) <= 240 AND length(x) >= 4 AND NOT {_boilerplate_sql('x')} AND NOT regexp_matches(x, '{_REJECTED_SQL}') AND regexp_matches(x, '{_PHRASE_SQL}'))"
_FIRST = "WITH f AS (SELECT conv_id AS session_id, coalesce(arg_min(text, turn), '') AS x FROM conversations WHERE role = 'user' GROUP BY ALL)"
_PLAIN = "lower(trim(regexp_replace(regexp_replace(x, '(?s)```.*?```', ' ', 'g'), '`[^`]*`', ' ', 'g'), ' '))"
QUERIES: dict[str, tuple] = {
    "tokenize_counts": (tokenize_counts, f"SELECT doc_id, len({_TOK})::INT AS tokens, len(list_distinct({_TOK}))::INT AS distinct_tokens FROM documents"),
    "fnv_postings": (fnv_postings, f"WITH c AS (SELECT session_id, token, count(*) AS n FROM (SELECT conv_id AS session_id, unnest({_TOK}) AS token FROM conversations) GROUP BY ALL) SELECT session_id, ({_FNV})::BIGINT AS token_id, sum(n)::BIGINT AS tf FROM c GROUP BY 1, 2"),
    "chunk_windows": (chunk_windows, f"WITH w AS (SELECT doc_id, {_W} AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, ceil((len(w) - 32) / 24.0) + 1) END::BIGINT)) AS i FROM w) SELECT doc_id, i::INT AS chunk_idx, md5(array_to_string(w[i * 24 + 1 : i * 24 + 32], ' ')) AS chunk_md5 FROM c"),
    "defanged": (defanged, f"SELECT doc_id, md5({_DEFANG(_MARKED)}) AS defanged_md5 FROM documents"),
    "plain_terminal": (plain_terminal, f"SELECT doc_id, md5({_NO_ANSI(_MARKED)}) AS plain_md5 FROM documents"),
    "summary_lines": (summary_lines, f"WITH s AS (SELECT doc_id, left(md5(doc_id::VARCHAR), 8) AS i, CASE WHEN doc_id % 5 <> 0 THEN source || '/' || lang || '/some-long-project-name' ELSE '?' END AS p, n_chars % 1000 AS turns, doc_id % 90 AS tools, CASE WHEN doc_id % 7 <> 0 THEN string_split({_T}, chr(10))[1] ELSE '' END AS t FROM documents), c AS (SELECT *, CASE WHEN length(p) > 22 THEN left(p, 21) || '…' ELSE p END AS cp, CASE WHEN length(t) > 60 THEN left(t, 59) || '…' ELSE t END AS ct FROM s) SELECT doc_id, i || '  ' || cp || repeat(' ', 22 - length(cp)) || '  ' || lpad(turns::VARCHAR, 5, ' ') || ' turns  ' || lpad(tools::VARCHAR, 5, ' ') || ' tools  ' || ct AS line FROM c"),
    "hook_outputs": (hook_outputs, _HOOKS),
    "response_errors": (response_errors, "SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_type = 'error' WHEN 1 THEN user_id % 3 <> 0 WHEN 5 THEN false ELSE event_type = 'error' END AS is_error FROM events"),
    "identifier_tokens": (identifier_tokens, f"WITH n AS (SELECT doc_id, 'get' || upper(left(lang, 1)) || substr(lang, 2) || 'Data_fromCache ' || source || '-' || lang || '/x.rs ' || string_split({_T}, chr(10))[1] AS n FROM documents), w AS (SELECT doc_id, list_filter(string_split_regex(n, '[{t.WHITE}]+'), lambda x: x <> '') AS w FROM n), c AS (SELECT doc_id, list_filter(flatten(list_transform(w, lambda x: list_concat([x], flatten(list_transform(string_split_regex(x, '[_-]'), lambda y: list_concat([y], string_split(regexp_replace(y, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), ' '))))))), lambda y: length(y) > 1) AS c FROM w) SELECT doc_id, array_to_string(list_filter(c, lambda y, i: list_position(c, y) = i), ' ') AS tokens FROM c"),
    "synth_title": (synth_title, f"WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND trim(text, ' ') <> ''), f AS (SELECT conv_id, arg_min(text, turn) AS x FROM u GROUP BY ALL) SELECT conv_id AS session_id, left({_SQ('''regexp_replace(x, '</?[a-z][a-z0-9-]*[^>]*>', ' ', 'g')''')}, 60) AS title FROM f"),
    "strip_tags": (strip_tags, f"SELECT page_id, md5({_SQ('''regexp_replace(coalesce(html, ''), '</?[a-z][a-z0-9-]*[^>]*>', ' ', 'g')''')}) AS plain_md5 FROM pages"),
    "redact": (redact, f"SELECT doc_id, md5({_redact_sql(_T, None)}) AS redacted_md5 FROM documents"),
    "clip_dedupe_key": (clip_dedupe_key, f"WITH k AS (SELECT doc_id, left({_SQ(f'''lower(regexp_replace({_WIDE}, '^[-*+•·→↪↵#>{t.WHITE}]+', ''))''')}, 120) AS k FROM documents), g AS (SELECT k, count(*) AS n, min(doc_id) AS first_id FROM k GROUP BY ALL HAVING count(*) > 1) SELECT CASE WHEN length(k) > 40 THEN left(k, 39) || '…' ELSE k END AS short_key, n, first_id FROM g"),
    "point_ids": (point_ids, "WITH s AS (SELECT DISTINCT conv_id AS session_id FROM conversations), h AS (SELECT session_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || session_id::VARCHAR::BLOB) AS r FROM s) SELECT session_id, substr(r, 1, 8) || '-' || substr(r, 9, 4) || '-5' || substr(r, 14, 3) || '-' || substr('89ab', ('0x' || substr(r, 17, 1))::INT % 4 + 1, 1) || substr(r, 18, 3) || '-' || substr(r, 21, 12) AS point_id, '#' || left(md5(session_id::VARCHAR), 8) AS short FROM h"),
    "url_buckets": (url_buckets, "WITH p AS (SELECT regexp_replace(coalesce(url, ''), '^[a-z]+:/', '') AS p FROM pages), s AS (SELECT p, list_filter(string_split(p, '/'), lambda x: x <> '') AS s FROM p) SELECT CASE WHEN len(s) <= 3 THEN p ELSE '/' || array_to_string(s[1:3], '/') || '/…' END AS bucket, count(*) AS n FROM s GROUP BY ALL"),
    "content_extract": (content_extract, f"{_CONTENT} SELECT session_id, md5(left({_redact_sql('content')}, 6000)) AS content_md5 FROM c"),
    "error_extract": (error_extract, f"SELECT conv_id AS session_id, count(*) AS lines FROM (SELECT conv_id, unnest(string_split({_T}, chr(10))) AS x FROM conversations WHERE role = 'assistant') WHERE regexp_matches(lower(x), 'error:|failed|traceback|panic|exception') GROUP BY ALL"),
    "code_extract": (code_extract, "WITH p AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?s)<p>(.*?)</p>', 1) AS x FROM pages) SELECT page_id, len(x)::INT AS parts, md5(coalesce(array_to_string(x, chr(10) || '---' || chr(10)), '')) AS parts_md5 FROM p"),
    "intent": (intent, "WITH s AS (SELECT user_id AS session_id, avg((event_type = 'click')::INT) AS a, avg((event_type IN ('purchase', 'signup'))::INT) AS b, avg((event_type = 'view')::INT) AS c FROM events GROUP BY ALL) SELECT session_id, CASE WHEN a > 0.21 THEN 'build' WHEN b > 0.21 THEN 'impl' WHEN c > 0.21 THEN 'debug' ELSE 'mixed' END AS intent FROM s"),
    "outcome": (outcome, f"WITH x AS (SELECT conv_id AS session_id, lower(coalesce(arg_max(text, turn), '')) AS l FROM conversations WHERE role = 'assistant' GROUP BY ALL), p AS (SELECT session_id, {_LASTPOS(enrich.POSITIVE)} AS g, {_LASTPOS(enrich.NEGATIVE)} AS b FROM x) SELECT session_id, CASE WHEN g > 0 AND g > b THEN 'resolved' WHEN b > 0 THEN 'unresolved' ELSE 'partial' END AS outcome FROM p"),
    "arc": (arc, "WITH c AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type AS n FROM events), f AS (SELECT session_id, count(*) AS n, count(*) FILTER (n = 'purchase') AS e, count(*) FILTER (n = 'view') AS r, count(*) FILTER (n IN ('click', 'error')) AS s, min(seq) FILTER (n = 'error') AS fb, max(seq) FILTER (n = 'click') AS lg, min(seq) FILTER (n = 'purchase') AS fe FROM c GROUP BY ALL), b AS (SELECT f.*, EXISTS (SELECT 1 FROM c WHERE c.session_id = f.session_id AND c.n = 'purchase' AND c.seq > f.fb AND c.seq < f.lg) AS d FROM f) SELECT session_id, CASE WHEN d THEN 'debug-fix' WHEN fe < lg THEN 'fix' WHEN e * 2 >= n AND s = 0 THEN 'impl' WHEN r * 2 >= n AND e = 0 THEN 'explore' ELSE 'mixed' END AS arc FROM b"),
    "last_call_ok": (last_call_ok, "WITH l AS (SELECT user_id AS session_id, arg_max(struct_pack(t := event_type, p := lower(props)), struct_pack(a := ts, b := event_id)) AS x FROM events WHERE event_type IN ('click', 'error') GROUP BY ALL) SELECT session_id, CASE WHEN x.t = 'error' THEN false WHEN contains(x.p, 'exit code 0') THEN true ELSE NOT regexp_matches(x.p, 'error|failed') END AS ok FROM l"),
    "entities": (entities, "WITH e AS (SELECT page_id AS session_id, unnest(regexp_extract_all(coalesce(url, ''), '([\\p{L}\\p{M}\\p{Nd}\\p{Pc}\\-./]+\\.[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]{1,5})', 1)) AS e FROM pages), k AS (SELECT session_id, regexp_replace(e, '[.,)\\]:;]+$', '') AS e FROM e), g AS (SELECT session_id, e, count(*) AS n FROM k WHERE strlen(e) >= 3 AND regexp_matches(e, '[./]') GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, e) AS r FROM g) SELECT session_id, string_agg(e, ' ' ORDER BY r) AS entities FROM r WHERE r <= 10 GROUP BY ALL"),
    "topics": (topics, f"{_FIRST} SELECT session_id, 'talk · ' || coalesce(array_to_string((list_filter(string_split_regex({_PLAIN}, '\\s+'), lambda w: w <> ''))[1:4], ' '), '') AS topic FROM f"),
    "decision_lines": (decision_lines, f"{_DECIDING}, {_DECIDED} SELECT conv_id AS session_id, count(*) AS n, max(c)::DOUBLE AS best, count(*) FILTER (c > 0.8) AS headers FROM d GROUP BY ALL"),
    "opening_lines": (opening_lines, f"{_FIRST}, l AS (SELECT session_id, list_filter(list_transform(string_split(x, chr(10)), lambda y: trim(y, ' ')), lambda y: NOT {_boilerplate_sql('y')})[1] AS y FROM f) SELECT session_id, CASE WHEN length(y) > 220 THEN left(y, 220) || '…' ELSE y END AS line FROM l"),
    "session_summary": (session_summary, f"SELECT conv_id AS session_id, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS assistant_turns, count(*) FILTER (role = 'system') AS system_events, sum(length({_T}))::BIGINT AS chars FROM conversations GROUP BY ALL ORDER BY conv_id DESC LIMIT 30"),
    "turn_lookup": (turn_lookup, f"SELECT conv_id AS session_id, role, md5({_T}) AS text_md5 FROM conversations WHERE turn = 2"),
}
