import pytest
from pyspark.sql import functions as F

from turnstone.functions import text as t
from turnstone.operators import activity, enrich, graph, retrieval as r, store


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column).first()[0]


def test_text_functions(spark):
    x = F.col("x")
    assert one(spark, t.fnv1a31(x), x="café") == 0x7FFFFFFF & __import__("functools").reduce(lambda h, b: (h ^ b) * 16777619 % 2**32, "café".encode(), 2166136261)
    assert one(spark, t.uuid5_dns(x), x="abc") == str(__import__("uuid").uuid5(__import__("uuid").NAMESPACE_DNS, "abc"))
    assert one(spark, t.title_of(x), x="<command-args> do  it </command-args> x") == "do it"
    assert one(spark, t.redact(x), x="password = hunter2hunter2hunter2 and Bearer abcdefghijklmnop") == "password=«redacted:secret» and «redacted:bearer»"
    assert one(spark, t.redact(x), x="x" * 30000) == "x" * 20000 + " …«truncated»" and one(spark, t.redact(x, None), x="x" * 30000) == "x" * 30000
    assert one(spark, t.redact(x), x="é" * 15000) == "é" * 15000
    across = "y" * 19990 + " ghp_" + "a1" * 20 + " end"
    assert one(spark, t.redact(x), x=across) == ("y" * 19990 + " «redacted:github-token» end")[:20000] + " …«truncated»"
    assert one(spark, t.identifier_tokens(x), x="fooBar baz_qux a") == ["fooBar", "foo", "Bar", "baz_qux", "baz", "qux"]
    assert one(spark, t.dedup_key(x), x="  - I'll   use X ") == "i'll use x"
    assert one(spark, t.bucket_path(x), x="/a/b/c/d") == "/a/b/c/…"
    chunks = one(spark, t.chunks(x), x=" ".join(map(str, range(100))))
    assert chunks[1].startswith("24 ") and len(one(spark, t.chunks(x), x="w " * 10000)) == 64 and one(spark, t.chunks(x), x="  ") == []
    assert one(spark, t.strip_ansi(x), x="\x1b[31mred\x1b[0m") == "red"
    assert "&lt;invoke" in one(spark, t.defang(x), x="<invoke> ```")
    found = one(spark, t.decisions(x), x="Stack: Spark and Parquet\nI'll use DuckDB here\nI'll use X but avoid Y\n<tag> let's use Z")
    assert [(d.text, d.confidence) for d in found] == [("Stack: Spark and Parquet", 0.9), ("I'll use DuckDB here", 0.7)]
    assert one(spark, t.meaningful_line(x), x="<system-reminder>\nskip\n</system-reminder>\nnote: no\nFix the bug") == "Fix the bug"
    assert one(spark, t.meaningful_line(x), x="<div>fix this</div> now\nkeep <b>") == "keep <b>" and one(spark, t.meaningful_line(x), x="Use <div>fix this</div>") == "Use <div>fix this</div>"
    assert one(spark, t.meaningful_line(x), x="a <bash-stdout>\nb\nc </bash-stdout> d\ne") == "e" and one(spark, t.meaningful_line(x), x="<command-name>\nnever closed") is None
    assert one(spark, t.input_summary(F.lit("Read"), x), x='{"file_path": "/a"}') == "/a" and one(spark, t.input_summary(F.lit("Other"), x), x='{"a":1}') == '{"a":1}'
    assert one(spark, t.call_paths(x), x='{"file_path": "/a", "url": "http://b", "path": ""}') == ["/a", "http://b"]
    for payload, bad in (('{"tool_response": {"is_error": true}}', True), ('{"tool_response": {"error": null, "exit_code": 0}}', False), ('{"tool_response": {"error": "x"}}', True), ('{"tool_response": {"code": 2}}', True), ('{"tool_response": "Fatal: no"}', True), ('{"tool_response": "fine"}', False), ('{"other": 1}', False), ("no json", False)):
        assert one(spark, t.response_is_error(x), x=payload) is bad
    for key, kind, want in (("s", "string", "a"), ("n", "bigint", 3), ("b", "boolean", True), ("n", "string", None), ("none", "bigint", None)):
        assert one(spark, t.payload_get(F.parse_json(x), key, kind), x='{"s": "a", "n": 3, "b": true}') == want
    assert one(spark, t.hook_output("Shell", x), x=" \x1b[31mred\x1b[0m ") == "red" and one(spark, t.hook_output("SessionStart", x), x="  ") is None
    assert __import__("json").loads(one(spark, t.hook_output("SessionStart", x), x="<invoke>")) == {"hookSpecificOutput": {"hookEventName": "SessionStart", "additionalContext": "&lt;invoke>"}}
    assert one(spark, t.has_title_tokens(x, F.lit("fix OTHER")), x="Fix authToken") is False and one(spark, t.has_title_tokens(x, F.lit("auth")), x="Fix authToken") is True
    assert len(one(spark, t.summary_line(x, F.lit("p"), F.lit(3), F.lit(4), F.lit("t")), x="abcdefghijk")) == 8 + 2 + 22 + 2 + 5 + 8 + 5 + 8 + 1
    assert one(spark, t.looks_like_error(x), x="Process exited with code 0 error:") is False
    t.register(spark)
    assert spark.sql("SELECT fnv1a31('a'), size(session_tokens('Ab c dé')), cosine_sim(array(1D, 0D), array(2D, 0D))").first()[:] == (0xE40C292C & 0x7FFFFFFF, 2, 1.0)


def test_enrichment(spark):
    calls = spark.createDataFrame([("a", 1, "Bash", "c1"), ("a", 2, "Read", "c2"), ("a", 3, "Edit", "c3"), ("a", 4, "Bash", "c4"), ("b", 1, "Edit", "d1"), ("b", 2, "Write", "d2"), ("c", 1, "Read", "e1"), ("d", 1, "Edit", "f1"), ("d", 2, "Bash", "f2")], "session_id string, seq int, name string, call_id string")
    results = spark.createDataFrame([("a", 5, "c1", "boom error", False), ("a", 6, "c4", "fine", False), ("d", 3, "f2", "ok", True)], "session_id string, seq int, call_id string, content string, is_error boolean")
    get = lambda df: {x[0]: x[1] for x in df.collect()}
    assert get(enrich.arc(calls, results)) == {"a": "debug-fix", "b": "impl", "c": "explore", "d": "mixed"}
    assert get(enrich.intent(calls)) == {"a": "build", "b": "impl", "c": "debug", "d": "build"}
    assert get(enrich.last_shell_ok(calls, results)) == {"a": True, "d": False}
    turns = spark.createDataFrame([("a", 1, "assistant", "error then fixed"), ("b", 1, "assistant", "works but fails"), ("c", 1, "assistant", "hm"), ("d", 1, "assistant", "cannot")], "session_id string, turn_index int, role string, text string")
    assert get(enrich.outcome(turns)) == {"a": "resolved", "b": "unresolved", "c": "partial", "d": "unresolved"}
    assert get(enrich.entities(spark.createDataFrame([("a", "see src/x.py, src/x.py and y.rs.")], "session_id string, text string"))) == {"a": ["src/x.py", "y.rs"]}
    assert one(spark, enrich.shell_word(F.col("x")), x="sudo make all") == "make"
    assert one(spark, enrich.topic(F.lit(""), F.lit("p"), F.col("x")), x="`code` Fix The big bad bug") == "p · fix the big bad"


def angle_points(spark, n=12):
    from math import cos, sin

    return spark.createDataFrame([(i, [cos(i / 7), sin(i / 7)], "pq"[i % 2], i % 3 == 0, 1000 * i, i) for i in range(n)], "id bigint, vec array<double>, project string, has_errors boolean, start_ts bigint, tool_count bigint")


def test_retrieval(spark):
    p = angle_points(spark)
    q = p.filter("id = 0").select(F.col("id").alias("query_id"), "vec")
    assert [x.id for x in r.neighbours(p, q, 3).orderBy("rank").collect()] == [1, 2, 3]
    assert {x.id for x in r.neighbours(p.filter("has_errors"), q, 2).collect()} == {3, 6}
    assert r.neighbours(p, q.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        r.lanes(p, q, [("content", 1, 2, 0.0, None)])
    with pytest.raises(ValueError):
        r.ordered(p, "title")
    same = p.withColumn("vec", F.array(F.lit(1.0), F.lit(0.0)))
    found = r.lanes(same, q, [("content", 1, 2, 1.0, None)])
    assert r.formula_fusion(found, same.withColumn("has_errors", F.lit(False)).withColumn("start_ts", F.col("id") * 86400 * 20), 86400 * 300, 1).first().id == 11
    pairs, target = r.pad_pairs([], [5])
    assert pairs == [(5, 5)] and target == 5
    clones = p.filter("id < 4").withColumn("vec", F.when(F.col("id") < 3, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.8), F.lit(0.6))))
    near = r.neighbours(clones, q.withColumn("query_id", F.lit(99).cast("bigint")), 4)
    assert [x.id for x in r.mmr(near, clones, 2, 0.7).orderBy("place").collect()] == [0, 3]
    perfect = r.neighbours(p, q, 3)
    assert r.ndcg(perfect, perfect.select("query_id", "id")).first().ndcg == 1.0


def test_graph(spark):
    p = angle_points(spark)
    forest = graph.spanning_forest(graph.pairs(p, 2))
    assert forest.count() == 11
    assert {(x.project, x.partner) for x in graph.bridges(forest, p).collect()} == {("p", "q"), ("q", "p")}
    assert graph.isolated(forest.limit(0), p).count() == 2


def test_store(spark, tmp_path):
    p = angle_points(spark)
    again = store.upsert(p, p.filter("id < 3").withColumn("project", F.lit("new")), "id")
    assert again.count() == 12 and again.filter("project = 'new'").count() == 3
    assert store.first_of_each(p.unionAll(p.withColumn("tool_count", F.lit(-1))), "id", "tool_count").filter("tool_count = -1").count() == 12
    assert store.index_report(p.unionAll(p), "id").first()[:] == (12, 12)
    old = spark.createDataFrame([("s", "2024-01-01T00:00:00Z"), ("", None), (None, None)], "session_id string, start_iso string")
    lifted = store.migrate(old, None)
    assert lifted.count() == 1 and lifted.first().intent is None and store.migrate(old, lifted).count() == 1
    path = str(tmp_path / "x.snapshot")
    store.export_snapshot(p, path)
    back, warnings = store.import_snapshot(spark, path)
    assert back.count() == 12 and not warnings
    back.limit(5).write.mode("append").parquet(f"{path}/data")
    with pytest.raises(ValueError):
        store.import_snapshot(spark, path)
    for wrong in ("", "a\0.snapshot", "../a.snapshot", "a.txt", "/etc/a.snapshot"):
        with pytest.raises(ValueError):
            store.check_path(wrong, "/data")
    assert store.check_path("a.snapshot", "/data") == "/data/a.snapshot"


def test_digest(spark):
    df = spark.createDataFrame([("a", 2), ("b", None)], "x string, n int")
    assert activity.markdown("T", [("S", df), ("E", df.limit(0))]) == "# T\n\n## S\n\n- a · 2\n- b\n"


def test_searches_beyond_one_block(spark, monkeypatch):
    """More query rows than a block or a matrix product holds; groups and exclusions look at all points."""
    import numpy as np

    rng = np.random.default_rng(8)
    vecs = rng.normal(size=(300, 4)).round(3)
    p = spark.createDataFrame([(i, v.tolist(), "abc"[i % 3] if i % 50 else "rare", i % 2 == 0) for i, v in enumerate(vecs)], "id bigint, vec array<double>, project string, has_errors boolean").repartition(5)
    q = p.select(F.col("id").alias("query_id"), "vec", "project")
    monkeypatch.setattr(r, "BLOCK_OCTETS", 8 * 4 * 70)
    monkeypatch.setattr(r._blocks, "__defaults__", (8 * 4 * 70, None))
    monkeypatch.setattr(r, "ROWS", 37)
    monkeypatch.setattr(r, "COLUMNS", 16)
    score = np.round(vecs @ vecs.T, 6)
    best = lambda i, keep, k: sorted((j for j in range(300) if j != i and keep(j)), key=lambda j: (-score[i, j], j))[:k]
    name = ["rare" if i % 50 == 0 else "abc"[i % 3] for i in range(300)]
    rows = lambda df: {(x.query_id, x.id, x["rank"]) for x in df.collect()}
    assert rows(r.neighbours(p, q, 3)) == {(i, j, k + 1) for i in range(300) for k, j in enumerate(best(i, lambda j: True, 3))}
    assert rows(r.neighbours(p, q, 3, other="project")) == {(i, j, k + 1) for i in range(300) for k, j in enumerate(best(i, lambda j: name[j] != name[i], 3))}
    few = q.filter("query_id < 90")
    got = {(x.query_id, x.group, x.id, x.in_group, x.place) for x in r.grouped(p, few, "project", 2, 5).collect()}
    want = set()
    for i in range(90):
        groups = sorted((best(i, lambda j: name[j] == g, 2) for g in set(name)), key=lambda b: (-score[i, b[0]], b[0]))
        want |= {(i, name[j], j, k + 1, n + 1) for n, (j, k) in enumerate([(j, k) for b in groups for k, j in enumerate(b)][:5])}
    assert got == want
    chunks = p.select("id", F.posexplode(F.array(F.slice("vec", 1, 2), F.slice("vec", 3, 2))).alias("chunk", "vec"))
    asked = q.select("query_id", F.posexplode(F.array(F.slice("vec", 1, 2), F.slice("vec", 3, 2))).alias("row", "vec"))
    half = [vecs[:, :2], vecs[:, 2:]]
    late = np.round(sum(np.maximum(a @ half[0].T, a @ half[1].T) for a in half), 6)
    every = r.maxsim(chunks, asked, 2).collect()
    assert {x.query_id for x in every} == set(range(300))
    assert {(x.query_id, x["rank"], x.score) for x in every} == {(i, k + 1, float(s)) for i in range(300) for k, s in enumerate(sorted(late[i], reverse=True)[:2])}


def test_store_additions(spark, tmp_path):
    p = angle_points(spark)
    report = {x.batch: (x.indexed, x.errors) for x in store.batch_report(p.withColumn("batch", F.floor(F.col("id") / 4)), "batch", "id = 5").collect()}
    assert report == {0: (4, 0), 1: (0, 4), 2: (4, 0)}
    good, bad = store.quarantined(p, "id = 5")
    assert (good.count(), bad.count()) == (11, 1)
    turns = spark.createDataFrame([("s", 0, "x")], "session_id string, turn_index int, text string")
    assert store.turn_at(turns, "s", 0).first().text == "x"
    with pytest.raises(IndexError):
        store.turn_at(turns, "s", 1)
    path = str(tmp_path / "store")
    assert store.read_current(spark, path) is None
    store.write_replacing(p.filter("id < 6"), path, "id")
    store.write_replacing(p.filter("id > 3").withColumn("project", F.lit("new")), path, "id")
    now = store.read_current(spark, path)
    assert now.count() == 12 and now.filter("project = 'new'").count() == 8
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x").write_text("")
    (tmp_path / "in" / "out").symlink_to("/etc")
    assert store.check_inside(str(tmp_path / "in" / "x"), [str(tmp_path / "in")]).endswith("/in/x")
    for wrong in ("", "a\0", str(tmp_path / "in" / "out"), str(tmp_path / "in" / "none")):
        with pytest.raises((ValueError, FileNotFoundError)):
            store.check_inside(wrong, [str(tmp_path / "in")])
    with pytest.raises(ValueError):
        graph.sample(p, 501)


def test_identifier_tokens_keep_their_case(spark):
    x = F.col("x")
    assert one(spark, t.identifier_tokens(x), x="getUserData refactor src/main.rs") == ["getUserData", "get", "User", "Data", "refactor", "src/main.rs"]
    assert one(spark, t.identifier_tokens(x), x="getUser_fromCache 4G a b") == ["getUser_fromCache", "getUser", "get", "User", "fromCache", "from", "Cache", "4G"]
    assert one(spark, t.identifier_tokens(x), x="low-power\u3000디버깅") == ["low-power", "low", "power", "디버깅"] and one(spark, t.identifier_tokens(x), x="") == []
    assert one(spark, t.has_title_tokens(x, F.lit("userdata data")), x="getUserData") is False and one(spark, t.has_title_tokens(x, F.lit("USER data")), x="getUserData")


def test_white_space_of_any_kind(spark):
    x = F.col("x")
    assert one(spark, t.dedup_key(x), x="\u3000- I\u00a0 USE\u2003X\u00a0") == "i use x"
    assert one(spark, t.chunks(x), x="a\u00a0b\u3000c\u0085") == ["a b c"]


def test_relative_times(spark):
    d = lambda a, b="2024-01-31": one(spark, t.relative_group(F.to_date("x"), F.lit(b).cast("date")), x=a)
    assert [d(a) for a in ("2024-01-31", "2024-02-03", "2024-01-30", "2024-01-25", "2024-01-24", "2024-01-03", "2024-01-02", "2024-01-01", "2023-12-31")] == ["Today", "Today", "Yesterday", "6 days ago", "Last week", "4w ago", "4w ago", "Jan", "Dec 23"]
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    ago = lambda a: one(spark, t.relative_ago(F.col("x").cast("timestamp"), now), x=a)
    assert [ago(a) for a in ("2024-01-30 23:59:01", "2024-01-30 23:01:00", "2024-01-30 00:00:01", "2024-01-02 00:00:00", "2024-01-01 00:00:00", "2023-11-01 00:00:00", None)] == ["59s ago", "59m ago", "23h ago", "29d ago", "4w ago", "3mo ago", "—"]


def test_session_entities(spark):
    calls = spark.createDataFrame([("a", "Bash", '{"command": "sudo cargo build --manifest-path a/Cargo.toml"}'), ("a", "Grep", '{"pattern": "src/*.rs"}'), ("a", "WebFetch", '{"url": "https://example.org/a.html"}'), ("a", "Read", '{"file_path": 7}'), ("a", "Bash", '{"command": "./run.sh x"}'), ("a", "Bash", None), ("b", "Bash", "not json")], "session_id string, name string, input_json string")
    turns = spark.createDataFrame([("a", "see größe.txt, a/Cargo.toml."), ("c", None)], "session_id string, text string")
    got = {r.session_id: r.entities for r in enrich.session_entities(calls, turns).collect()}
    assert got == {"a": ["a/Cargo.toml", "./run.sh", "cargo", "größe.txt", "src/*.rs"]}


def test_dashboard_figures(spark):
    days = spark.createDataFrame([(1, "2024-01-30 10:00:00"), (1, "2024-01-29 01:00:00"), (1, "2024-01-29 02:00:00"), (1, "2024-01-27 00:00:00"), (2, "2024-01-29 00:00:00"), (3, "2024-01-31 00:00:00"), (3, "2024-01-30 00:00:00")], "user_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r.user_id: r.days for r in activity.current_streak(days, F.lit("2024-01-30").cast("date")).collect()} == {1: 2, 2: 0, 3: 1}
    rows = [("2024-01-30 00:00:00", 3, 1, True, "a"), ("2024-01-24 00:00:00", 2, 0, False, None), ("2024-01-23 23:59:59", 9, 4, True, "a"), ("2024-01-31 00:00:00", 50, 50, True, "z"), (None, 50, 50, True, "z")]
    s = spark.createDataFrame(rows, "start_ts string, turns int, tools int, has_errors boolean, project string").withColumn("start_ts", F.col("start_ts").cast("timestamp"))
    got = {r.metric: (r.current, r.previous) for r in activity.week_stats(s, F.lit("2024-01-31").cast("timestamp")).collect()}
    assert got == {"sessions": (2, 1), "turns": (5, 9), "tools": (1, 4), "error_sessions": (1, 1), "projects": (2, 1)}
    assert tuple(activity.tiles(s).first()) == (5, 114, 105, 4)


@pytest.mark.parametrize("seed", [0, 1])
def test_forest_of_any_graph(spark, seed):
    import random

    rng = random.Random(seed)
    edges = {(min(a, b), max(a, b)): round(rng.choice([0.5, rng.random()]), 3) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(110)) if a != b}
    df = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()] + [(70, 71, 1.5), (70, 71, 0.2), (5, 5, 0.9)], "a bigint, b bigint, score double")
    want = sorted(map(tuple, graph.spanning_forest(df.filter("a <> b")).collect()))
    assert sorted(map(tuple, graph.forest_of_any(df).collect())) == want and (70, 71, 0.0) in want
    assert graph.forest_of_any(df.limit(0)).count() == 0
