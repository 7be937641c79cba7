"""The watcher's batch over many sessions: what it parses, moves and searches for, with the alerts of the plain way."""

import json

import numpy as np
from pyspark.sql import functions as F

from turnstone.operators import activity, retrieval as r
from turnstone.sources import sessions as logs
from turnstone.streaming import tick


def turn(session, n, tools, bad=False, content="fine"):
    items = [{"type": "text", "text": "hello again"}, *({"type": "tool_use", "id": "c", "name": t, "input": {}} for t in tools), {"type": "tool_result", "tool_use_id": "c", "content": content, "is_error": bad}]
    return json.dumps({"type": "assistant", "sessionId": session, "uuid": f"u{n:03}", "timestamp": f"2024-01-01T00:{n:02}:00Z", "cwd": "/srv/p", "message": {"content": items}})


def test_a_line_is_parsed_once(spark):
    odd = [
        {"content": "plain words"}, {"content": [1, "x", None, {"type": "text", "text": 5}, {"type": "text"}, {"type": "text", "text": {"a": 1}}]}, {"content": None}, {}, {"content": {"type": "text"}},
        {"content": [{"type": "tool_use", "id": 7, "name": "N", "input": None}, {"type": "tool_use", "input": [1.50, {"b": "c"}]}]},
        {"content": [{"type": "tool_result", "tool_use_id": "t", "content": [{"text": "a"}, "b", {"text": None}, {"text": 3}], "is_error": "true"}, {"type": "tool_result", "content": {"text": "o"}, "is_error": {}}]},
    ]
    rows = [(json.dumps({"type": "user", "sessionId": "s", "uuid": f"u{i}", "message": m}), i) for i, m in enumerate(odd)] + [("no json", 9), (json.dumps({"type": "system", "sessionId": "s", "uuid": "x"}), 9), ('{"type":"user","sessionId":"s"}', 9)]
    got = logs.spoken_turns(spark.createDataFrame(rows, "line string, n int"), "n").orderBy("n")
    assert got._jdf.queryExecution().executedPlan().toString().count("parseJson(") == 1
    have = [(x.n, x.text, [tuple(c) for c in x.calls], [tuple(c) for c in x.results]) for x in got.collect()]
    assert have == [
        (0, "plain words", [], []), (1, '5\n\n{"a":1}', [], []), (2, "", [], []), (3, "", [], []), (4, '{"type":"text"}', [], []),
        (5, "", [("7", "N", "null"), (None, None, '[1.5,{"b":"c"}]')], []),
        (6, "", [], [("t", "a\n3", True), (None, '{"text":"o"}', False)]),
    ]


def test_a_sessions_turns_move_once(spark):
    """After turns were placed, nothing that is found by session moves them again."""
    turns = tick.noted(logs.spoken_turns(spark.createDataFrame([(turn(str(s), n, ["Read"]),) for s in range(5) for n in range(4)], "line string")))
    placed = tick.indexed(turns).persist()
    assert [(x.turn_index, x.back) for x in placed.filter("id = 3").orderBy("turn_index").collect()] == [(0, 4), (1, 3), (2, 2), (3, 1)]
    plan = placed.groupBy("id").agg(F.count(F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    placed.unpersist()
    # Above the kept table, whose own plan follows.
    assert "Exchange" not in plan[: plan.index("InMemoryTableScan")]


def test_sessions_that_nothing_can_be_told_are_not_searched_for(spark, monkeypatch):
    """Of sessions that aren't stuck, those that used every tool there is have no new tool to hear of."""
    lines = [turn(str(s), n, ["Read", "Edit"] if s % 2 else ["Read"]) for s in range(1, 9) for n in range(5)] + [turn("20", n, ["Read", "Edit"], n > 8) for n in range(13)]
    asked = []

    def neighbours(points, queries, k, **options):
        asked.append({x.query_id for x in queries.collect()})
        return r.neighbours(points, queries, k, **options)

    monkeypatch.setattr(tick, "retrieval", type("", (), {"neighbours": staticmethod(neighbours)}))
    turns = tick.noted(logs.spoken_turns(spark.createDataFrame([(x,) for x in lines], "line string"))).withColumn("hot", F.lit(True)).withColumn("known", F.lit(False))
    said = tick.found(tick.indexed(turns), lambda s: s.select("id", F.array(F.lit(1.0), F.lit(0.5)).alias("vec"))).collect()
    assert {2, 4, 6, 8, 20} in asked and not any({1, 3, 5, 7} & x for x in asked)
    assert {(x.kind, x.session_id) for x in said if x.kind != "primer"} == {("loop", "20")} and sum(x.kind == "primer" for x in said) == 9


def test_products_in_single_precision_lose_none(spark):
    """Scores that differ in the sixth digit and beyond, ties, queries of any length, and vectors too long for single precision."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 24))
    for scale in (1.0, 1e-4, 1e20):
        v = (base[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 24)) * 1e-6) * scale
        v[700:720] = v[3]
        q = v[::50]
        points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, vec array<double>")
        asked = points.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vec")
        got = {}
        for x in r.neighbours(points, asked, 7).collect():
            got.setdefault(x.query_id, []).append((x["rank"], x.id, x.score))
        exact = np.round(np.einsum("ik,jk->ij", v, q), 6)
        for j in range(30):
            want = sorted((-s, i) for i, s in enumerate(exact[:, j]) if i != 50 * j)[:7]
            have = sorted(got[50 * j])
            assert np.allclose([s for *_, s in have], [-s for s, _ in want], rtol=1e-12, atol=1.1e-6)
            if scale == 1.0:
                assert [i for _, i, _ in have] == [i for _, i in want]


def test_only_what_may_enter_is_worked_out():
    rng = np.random.default_rng(6)
    v, q = rng.normal(size=(4000, 16)), rng.normal(size=(50, 16))
    best, worked = r.Best(50, 5), []
    enter = best._enter
    best._enter = lambda ids, row, *rest: (worked.append(len(row)), enter(ids, row, *rest))
    slack = 20 * 2.0**-24 * np.sqrt((v * v).sum(axis=1).max()) * np.sqrt((q * q).sum(axis=1))
    for at in range(0, 4000, 500):
        part = v[at : at + 500]
        best.add_products(np.arange(at, at + 500), part, q, part.astype(np.float32) @ q.astype(np.float32).T, slack)
    col, who, value = best.rows()
    score = np.round(v @ q.T, 6)
    assert all(sorted(who[col == j]) == sorted(np.lexsort((np.arange(4000), -score[:, j]))[:5]) for j in range(50))
    assert sum(worked) < 0.01 * 4000 * 50


def test_the_most_frequent_turn_is_counted(spark):
    """The first of the turns with most of a query's words; none where there are fewer than two."""
    turns = spark.createDataFrame([(1, 0, "alpha"), (1, 1, "alpha bravo"), (1, 2, "bravo alpha"), (1, 3, "other"), (2, 0, "alpha"), (2, 1, "other"), (2, 2, "other")], "session_id bigint, turn_index int, text string")
    near = spark.createDataFrame([(7, 1), (7, 2)], "query_id bigint, session_id bigint")
    anchors = spark.createDataFrame([(7, "alpha"), (7, "bravo")], "query_id bigint, word string")
    assert {(x.session_id, x.pivot) for x in activity.pivots_by_query(near, turns, anchors).collect()} == {(1, 1), (2, 2)}
