import datetime
import json
import os
import time

from pyspark.sql import functions as F

from turnstone.sources import sessions as logs
from turnstone.streaming import tick, watch


def line(session, n, results=(), text="hello", tool="Read", cwd="/srv/p", at=None):
    items = [{"type": "text", "text": text}, {"type": "tool_use", "id": f"c{n}", "name": tool, "input": {}}, *({"type": "tool_result", "tool_use_id": f"c{n}", "content": c, "is_error": bad} for c, bad in results)]
    stamp = datetime.datetime.fromtimestamp(1_704_067_200 + (at if at is not None else 60 * n), datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return json.dumps({"type": "assistant", "sessionId": session, "uuid": f"u{n:04}", "timestamp": stamp, "cwd": cwd, "message": {"content": items}})


def write(path, rows, age=0):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(rows) + "\n")
    os.utime(path, (time.time() - age,) * 2)


def test_recent_errors(spark, tmp_path):
    bad = lambda *texts: [(x, True) for x in texts]
    write(tmp_path / "a.jsonl", [line("a", 0, bad("old")), line("a", 1, bad("real one", "x" * 900)), line("a", 2, bad("Exit code 1")), line("a", 3, [("fine", False)]), line("a", 4, bad("bash: jq: Command not found"))])
    write(tmp_path / "b.jsonl", [line("b", 0, bad("too far back")), *[line("b", n) for n in range(1, 7)]])
    write(tmp_path / "c.jsonl", [line("c", 0, bad("stale"))], age=4000)
    write(tmp_path / "p" / "d.jsonl", [line("d", 0, bad("Parse error")), line("d", 1, bad("kept"), text="error: said only")])
    write(tmp_path / "subagents" / "e.jsonl", [line("e", 0, bad("of another"))])
    since = F.current_timestamp() - F.expr("INTERVAL 1 HOUR")
    got = {r.session_id: (r.turn_index, r.error_text, r.project_name) for r in logs.recent_errors(spark, str(tmp_path), since).collect()}
    assert got == {"a": (1, "x" * 800, "p"), "d": (1, "kept", "p")}
    assert logs.recent_errors(spark, str(tmp_path / "none"), since).count() == 0


def test_five_waits(spark, tmp_path):
    rows = [(kind, "k", i, 30 * i) for kind in (*watch.WAITS, "other") for i in range(300)]
    df = spark.createDataFrame(rows, "kind string, key string, event_id bigint, at bigint").withColumn("ts", F.timestamp_seconds(F.col("at") + 1_704_067_200)).drop("at")
    got = watch.replay(df, watch.waited, str(tmp_path / "w"), slices=5)
    have = {r.kind: r.n for r in got.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert have == {k: -(-300 // (w // 30)) for k, w in watch.WAITS.items()} | {"other": 300}


def test_keys_of_alerts(spark):
    df = spark.createDataFrame([(k, "s", "Bash", "e" * 200) for k in ("recall", "predict", "loop", "primer")], "kind string, session string, tool string, content string")
    got = {r.kind: r.k for r in df.select("kind", watch.alert_key(F.col("kind"), F.col("session"), F.col("tool"), F.col("content")).alias("k")).collect()}
    assert got == {"recall": "s|" + "e" * 120, "predict": "s|bash", "loop": "s", "primer": "s"}


def test_batches_of_logs(spark, tmp_path):
    """Two sessions of a project, then a third one that fails alike: a primer, a recall and a loop; each once within its wait."""
    root, store = tmp_path / "logs", str(tmp_path / "store")
    vectors = lambda s: s.select("id", F.array(F.lit(1.0), F.lit(0.5)).alias("vec"))
    for k, s in enumerate(("1", "2")):
        write(root / f"{s}.jsonl", [line(s, n, [("disk quota exceeded", n == 9)], tool="Bash", at=40 * n + k) for n in range(10)])
    tick.watch(spark, str(root), store, vectors)
    first = {(r.kind, r.session_id, r.target) for r in tick.alerts(spark, store).collect()}
    assert first == {("recall", "1", "2"), ("recall", "2", "1")}
    write(root / "3.jsonl", [line("3", n, [("disk quota exceeded", n > 8)], at=40 * n + 5) for n in range(13)])
    tick.watch(spark, str(root), store, vectors)
    second = {(r.kind, r.session_id, r.target) for r in tick.alerts(spark, store).filter("batch = 1").collect()}
    assert second == {("recall", "3", "1"), ("primer", "3", "2"), ("loop", "3", "Bash"), ("predict", "3", "Bash")}
    write(root / "3b.jsonl", [line("3", n, [("disk quota exceeded", True)], at=40 * n + 5) for n in (13, 14)])
    tick.watch(spark, str(root), store, vectors)
    assert tick.alerts(spark, store).filter("batch = 2").count() == 0
    write(root / "3c.jsonl", [line("3", 15, [("disk quota exceeded", True)], at=40 * 12 + 5 + 1200)])
    tick.watch(spark, str(root), store, vectors)
    assert {r.kind for r in tick.alerts(spark, store).filter("batch = 3").collect()} == {"loop"}
    write(root / "4.jsonl", ["not json", line("4", 0)], age=600)
    write(root / "5.jsonl", [line("5", 0, cwd="/else")])
    tick.watch(spark, str(root), store, vectors)
    assert tick.alerts(spark, store).filter("batch = 4").count() == 0
