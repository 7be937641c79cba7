import json

import pytest

from turnstone.sources import sessions as s


def write(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def claude(i, **more):
    return {"type": "user", "sessionId": "s1", "uuid": f"u{i}", "timestamp": f"2024-01-01T00:00:{i:02d}Z", "cwd": "/home/me/proj", "gitBranch": "main", "version": "1.0", "message": {"role": "user", "content": f"turn {i}"}, **more}


def test_claude(spark, tmp_path):
    root = tmp_path / "claude"
    write(root / "a", "one.jsonl", [
        claude(0, message={"content": "<system-reminder>noise</system-reminder>"}),
        claude(1, message={"content": "  Please   <b>fix</b> it "}),
        {"type": "assistant", "uuid": "a1", "parentUuid": "u1", "timestamp": "2024-01-01T00:01:00Z", "message": {"content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "c1", "name": "Bash", "input": {"command": "make"}}, {"type": "tool_use", "id": "c2", "name": "Read", "input": {"file_path": "/x"}}, {"type": "image"}]}},
        "",
        {"type": "user", "uuid": "u2", "isSidechain": True, "message": {"content": [{"type": "tool_result", "tool_use_id": "c1", "content": [{"text": "bad"}, {"text": "news"}], "is_error": True}, {"type": "tool_result", "tool_use_id": "c2", "content": "fine"}]}},
        {"type": "assistant", "message": {"content": "no uuid"}},
        {"type": "system", "timestamp": "2023-12-31T00:00:00Z"},
        {"type": "attachment"},
    ])
    write(root / "b", "two.jsonl", [{"type": "user", "uuid": "x", "message": {"content": "hi"}}, {"type": "ai-title", "title": "Old title"}, {"type": "ai-title", "aiTitle": "Late"}])
    write(root / "c", "bad.jsonl", [claude(1), "{not json"])
    write(root / "a" / "subagents", "agent.jsonl", [claude(1)])
    got = s.read_claude(spark, str(root))
    one, two = sorted(got.sessions.collect(), key=lambda r: r.session_id)
    assert (one.session_id, one.title, one.project_name, one.git_branch) == ("s1", "Please fix it", "proj", "main")
    assert (one.user_turns, one.assistant_turns, one.system_events, one.other_events) == (3, 2, 1, 1)
    assert str(one.start_ts) == "2023-12-31 00:00:00" and str(one.end_ts) == "2024-01-01 00:01:00"
    assert (two.session_id, two.title, two.other_events) == ("two", "Old title", 2)
    turns = got.turns.filter("session_id = 's1'").orderBy("turn_index").collect()
    assert [(t.role, t.uuid, t.is_sidechain) for t in turns] == [("user", "u0", False), ("user", "u1", False), ("assistant", "a1", False), ("user", "u2", True)]
    assert [(c.turn_index, c.name, json.loads(c.input_json)) for c in got.calls.orderBy("call_seq").collect()] == [(2, "Bash", {"command": "make"}), (2, "Read", {"file_path": "/x"})]
    assert [(r.turn_index, r.call_id, r.content, r.is_error) for r in got.results.orderBy("result_seq").collect()] == [(3, "c1", "bad\nnews", True), (3, "c2", "fine", False)]
    assert [r.reason for r in got.bad.collect()] == ["line 2 is not JSON"]


def test_legacy(spark, tmp_path):
    write(tmp_path, "ses_x.jsonl", [{"type": "user", "timestamp": "2024-01-01T00:00:00Z", "content": "go"}, {"type": "tool_use", "tool_name": "bash", "tool_input": {"a": 1}}, {"type": "tool_result", "tool_name": "bash", "tool_output": "Error: no"}, "oops", {"type": "tool_use", "tool_name": "read", "tool_input": {}}, {"type": "user", "content": "more"}])
    write(tmp_path, "other.jsonl", [{"type": "user", "content": "x"}])
    got = s.read_legacy(spark, str(tmp_path))
    assert [(t.role, t.text, t.uuid) for t in got.turns.orderBy("turn_index").collect()] == [("user", "go", "ses_x-u1"), ("assistant", "", "ses_x-a1"), ("user", "more", "ses_x-u2")]
    assert [(c.turn_index, c.name) for c in got.calls.orderBy("call_seq").collect()] == [(1, "bash"), (1, "read")]
    assert [(r.content, r.is_error) for r in got.results.collect()] == [("Error: no", True)]
    assert got.sessions.first().project_name == "(legacy transcript)"


def item(payload, i=0):
    return {"timestamp": f"2024-01-01T00:00:{i:02d}Z", "type": "response_item", "payload": payload}


def test_rollouts(spark, tmp_path):
    meta = {"timestamp": "2024-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": "r1", "cwd": "/w/app", "cli_version": "0.1"}}
    say = lambda role, text: {"type": "message", "role": role, "content": [{"type": "text", "text": text}]}
    write(tmp_path / "d", "rollout-1.jsonl", [meta, item({"type": "function_call", "name": "shell", "arguments": '{"x":1}', "call_id": "c0"}), item(say("user", "hello\nthere")), item(say("assistant", "a1")), item({"type": "function_call", "name": "shell", "arguments": "{}", "call_id": "c1"}), item(say("assistant", "a2")), item({"type": "function_call_output", "call_id": "c1", "output": "Exit code 1"}), item({"type": "function_call_output", "call_id": "zz", "output": "lost"}), item({"type": "function_call_output", "call_id": "c0", "output": "Process exited with code 0\nerror:"}), item(say("developer", "no")), {"type": "event_msg", "payload": {}}])
    write(tmp_path / "d", "rollout-2.jsonl", [item(say("user", "x")), meta])
    got = s.read_rollouts(spark, str(tmp_path))
    assert [(t.role, t.text) for t in got.turns.orderBy("turn_index").collect()] == [("assistant", ""), ("user", "hello\nthere"), ("assistant", "a1"), ("assistant", "a2"), ("user", "")]
    assert sorted((r.turn_index, r.call_id, r.is_error) for r in got.results.collect()) == [(1, "c0", False), (4, "c1", True)]
    assert (got.sessions.first().session_id, got.sessions.first().title, got.sessions.count(), got.bad.count()) == ("r1", "hello there", 1, 1)
    both = s.read_all(spark, {"auto": str(tmp_path)})
    assert both.sessions.count() == 1 and s.kind_of(spark, str(tmp_path)) == "codex"
    with pytest.raises(ValueError):
        s.read_all(spark, {})


def test_prompt_history_and_embedding(spark, tmp_path):
    from turnstone.operators.activity import prompt_days

    write(tmp_path, "history.jsonl", [{"timestamp": 1704067200000, "project": "a"}, {"timestamp": "1704067300000", "project": ""}, {"timestamp": -5}, "broken", {"display": "x"}])
    days = prompt_days(s.prompt_history(spark, str(tmp_path / "history.jsonl"))).collect()
    assert [(str(r.day), r.n, r.projects) for r in days] == [("2024-01-01", 2, 1)]
    rows = s.embed(spark.createDataFrame([(1, "a fix"), (2, None)], "id int, text string"), 8).collect()
    assert abs(sum(x * x for x in rows[0].vec) - 1) < 1e-9 and rows[1].vec is None


def test_missing_roots_are_empty(spark, tmp_path):
    gone = str(tmp_path / "gone")
    for read in (s.read_claude, s.read_legacy, s.read_rollouts):
        got = read(spark, gone)
        assert [df.count() for df in got] == [0] * 5
    assert s.prompt_history(spark, gone).count() == 0 and s.kind_of(spark, gone) == "claude_code"
    write(tmp_path / "a", "one.jsonl", [claude(0)])
    assert s.read_all(spark, {"claude_code": str(tmp_path / "a"), "legacy": gone}).sessions.count() == 1


def test_lines_keep_their_order_in_parts(spark, tmp_path):
    write(tmp_path, "long.jsonl", [{"n": i, "pad": "x" * (i % 90)} for i in range(3000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = s.lines(spark, str(tmp_path))
        assert s._text(spark, str(tmp_path), "*.jsonl", True).rdd.getNumPartitions() > 1 and [(r.line_no, json.loads(r.line)["n"]) for r in got.orderBy("line_no").collect()] == [(i, i) for i in range(3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def rollout_by_hand(items):
    """The rules, item by item."""
    turns = []
    for x in items:
        if x["type"] == "message":
            if x["role"] in ("user", "assistant") and x["content"][0]["text"].strip():
                turns.append([x["role"], [], []])
        elif x["type"] == "function_call":
            owner = next((u for u in reversed(turns) if u[0] == "assistant"), None)
            if owner is None:
                owner = ["assistant", [], []]
                turns.append(owner)
            owner[1].append(x["call_id"])
        else:
            at = next((i for i in range(len(turns) - 1, -1, -1) if turns[i][0] == "assistant" and x["call_id"] in turns[i][1]), None)
            if at is None:
                continue
            taker = next((u for u in turns[at + 1 :] if u[0] == "user"), None)
            if taker is None:
                taker = ["user", [], []]
                turns.append(taker)
            taker[2].append(x["call_id"])
    return turns


def test_rollouts_against_rules_item_by_item(spark, tmp_path):
    import random

    want = {}
    for seed in range(30):
        rng = random.Random(seed)
        items = []
        for _ in range(rng.randint(1, 25)):
            kind = rng.choice(["say", "call", "out"])
            items.append({"type": "message", "role": rng.choice(["user", "assistant", "developer"]), "content": [{"type": "text", "text": rng.choice(["hi", " "])}]} if kind == "say" else {"type": "function_call", "name": "f", "arguments": "{}", "call_id": f"c{rng.randint(0, 4)}"} if kind == "call" else {"type": "function_call_output", "call_id": f"c{rng.randint(0, 4)}", "output": "ok"})
        write(tmp_path, f"rollout-{seed}.jsonl", [{"timestamp": "2024-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": f"r{seed}", "cwd": "/w", "cli_version": "0"}}, *map(item, items)])
        want[f"r{seed}"] = rollout_by_hand(items)
    got = s.read_rollouts(spark, str(tmp_path))
    turns, calls, results = got.turns.orderBy("turn_index").collect(), got.calls.orderBy("turn_index", "call_seq").collect(), got.results.orderBy("turn_index", "result_seq").collect()
    for name, rows in want.items():
        at = lambda found, i: [r.call_id for r in found if r.session_id == name and r.turn_index == i]  # noqa: B023, E731
        own = [t.role for t in turns if t.session_id == name]
        assert [(r, at(calls, i), at(results, i)) for i, r in enumerate(own)] == [tuple(x) for x in rows], name
