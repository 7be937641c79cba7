import pytest
from pyspark.sql import functions as F

from turnstone import cli
from turnstone.operators import memory, store
from tests.test_sources import claude, write


def test_primer_parts(spark):
    turns = spark.createDataFrame([("a", 0, "user", "<command-name>x</command-name>\nFix the login page"), ("a", 1, "assistant", "I'll use Redis here"), ("b", 0, "user", "- fix the  login page"), ("b", 1, "assistant", "Decision: keep Parquet")], "session_id string, turn_index int, role string, text string")
    src = spark.createDataFrame([("a", 1.0), ("b", 0.2)], "session_id string, similarity double")
    assert [r.line for r in memory.intents(turns, src).collect()] == ["Fix the login page"]
    assert [(r.text, r.confidence) for r in memory.decisions(turns, src).collect()] == [("I'll use Redis here", 0.7), ("Decision: keep Parquet", 0.45)]
    results = spark.createDataFrame([("a", 1, "\nboom: no such table\nat x", True), ("b", 1, "The user has interrupted", True), ("b", 2, "fine", False)], "session_id string, turn_index int, content string, is_error boolean")
    assert [r.line for r in memory.pitfalls(results, src).collect()] == ["boom: no such table"]
    calls = spark.createDataFrame([("a", 1, "Bash", '{"command":"make all"}'), ("a", 1, "Edit", '{"file_path":"/x/y.py"}')], "session_id string, turn_index int, name string, input_json string")
    assert {tuple(r) for r in memory.stack(calls, src).collect()} == {("tool", "Bash", 1), ("tool", "Edit", 1), ("extension", ".py", 1), ("program", "make", 1)}
    assert [r.program for r in memory.programs(calls).collect()] == ["make"]


def test_cli(spark, tmp_path):
    write(tmp_path / "p", "one.jsonl", [claude(0, message={"content": "fix the parser bug in lexer"}), claude(1, message={"content": [{"type": "tool_result", "tool_use_id": "c", "content": "error: parser", "is_error": True}]})])
    write(tmp_path / "q", "two.jsonl", [claude(0, sessionId="s2", cwd="/home/me/other", message={"content": "write release notes"})])
    root = ["--root", f"claude_code={tmp_path}"]
    args = lambda *a: cli.argparse.Namespace(command=a[0], text=a[1], root=[root[1]], limit=10, days=0, as_of="2024-02-01 00:00:00", folder=str(tmp_path))
    assert [r.session_id for r in cli.run(spark, args("scan", "")).collect()] == ["s1", "s2"]
    assert cli.run(spark, args("search", "parser bug")).first().session_id == "s1"
    assert [r.session_id for r in cli.run(spark, args("recall", "fix the parser bug in lexer")).collect()] == ["s1"]
    assert cli.run(spark, args("topology", "")).count() == 2
    assert "fix the parser bug in lexer" in cli.run(spark, args("memory", "proj"))
    assert "## Projects" in cli.run(spark, args("wrapped", ""))
    assert "## Outcomes" in cli.run(spark, args("wrapped", "")) and "## Arcs" in cli.run(spark, args("wrapped", ""))
    assert {r.session_id: r.error for r in cli.run(spark, args("extracts", "")).collect()} == {"s1": "error: parser", "s2": "(no errors)"}
    assert {r.session_id: (r.intent, r.arc) for r in cli.run(spark, args("enrich", "")).collect()} == {"s1": ("mixed", "mixed"), "s2": ("mixed", "mixed")}
    assert cli.run(spark, args("turn", "s1#0")).first().text == "fix the parser bug in lexer"
    with pytest.raises(IndexError):
        cli.run(spark, args("turn", "s1#9"))
    for _ in range(2):
        assert cli.run(spark, args("reindex", "/home/me/proj")) == "written"
        assert [r.session_id for r in store.read_current(spark, f"{tmp_path}/points").collect()] == ["s1"]
    assert cli.run(spark, args("snapshot", "x.snapshot")) == "written"
    assert spark.read.parquet(f"{tmp_path}/x.snapshot/data").filter(F.col("vec").isNotNull()).count() == 2
