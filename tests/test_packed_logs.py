"""An archive of logs is read as the logs themselves are."""

import json
from pathlib import Path

from turnstone.plans import logs as plans
from turnstone.sources import sessions as logs


def test_an_archive_reads_as_its_files(spark, tmp_path):
    line = lambda i, n: json.dumps({"type": "user" if n % 2 else "assistant", "sessionId": f"s{i}", "uuid": f"u{n}", "timestamp": f"2024-01-01T00:00:{n:02}Z", "cwd": "/srv/p", "message": {"content": f"text {n}"}})
    rows = [(f"{tmp_path}/logs/{i}.jsonl", n, line(i, n)) for i in range(12) for n in range(15)] + [(f"{tmp_path}/logs/bad.jsonl", 0, line(99, 0)), (f"{tmp_path}/logs/bad.jsonl", 1, "{"), (f"{tmp_path}/logs/0.jsonl", 15, "  ")]
    (tmp_path / "logs").mkdir()
    for path, _, text in rows:
        with open(path, "a") as f:
            f.write(text + "\n")
    logs.pack(spark.createDataFrame(rows, "source_path string, place bigint, line string").repartition(5), f"{tmp_path}/packed")
    one, other = logs.read_claude(spark, f"{tmp_path}/logs"), logs.read_claude(spark, f"{tmp_path}/packed", logs.PACKED)
    for name in ("sessions", "turns"):
        a, b = (sorted(map(str, getattr(x, name).drop("source_path").collect())) for x in (one, other))
        assert a == b and len(a) in (12, 180)
    assert [r.reason for r in one.bad.collect()] == [r.reason for r in other.bad.collect()] == ["line 2 is not JSON"]


def test_files_grow_by_octets_not_by_sessions(spark, tmp_path):
    rows = [(i, n, "{}") for i in range(300) for n in range(2)]
    folder = plans._write(spark.createDataFrame(rows, "file bigint, order bigint, line string"), spark)
    assert len(list(Path(folder.removeprefix("file:")).rglob("part-*"))) <= spark.sparkContext.defaultParallelism
    assert logs.lines(spark, folder, logs.PACKED).select("source_path").distinct().count() == 300
