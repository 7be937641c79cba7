from pyspark.sql import functions as F

from turnstone.streaming import watch


def events(spark, path):
    rows = [(s, 100 * s + i, 1704067200 + 60 * i, i % 3 == 0) for s in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "session_id bigint, event_id bigint, at bigint, is_error boolean").select("session_id", "event_id", F.timestamp_seconds("at").alias("ts"), F.lit("x").alias("name"), "is_error")
    df.repartition(3, "session_id").write.parquet(path)
    return df


def run(spark, tmp_path, build, mode="append"):
    static = events(spark, str(tmp_path / "in"))
    stream = watch.read_events(spark, str(tmp_path / "in"), static.schema, 1)
    watch.run_once(build(stream), str(tmp_path / "out"), str(tmp_path / "cp"), mode)
    return static, spark.read.parquet(str(tmp_path / "out"))


def test_stuck_alerts(spark, tmp_path):
    _, got = run(spark, tmp_path, watch.stuck_alerts)
    by = {}
    for r in got.orderBy("ts").collect():
        by.setdefault(r.session_id, []).append(int(r.ts.timestamp()))
    assert set(by) == {1, 2}
    for times in by.values():
        assert len(times) == 2 and all(b - a >= watch.DEBOUNCE_SECONDS for a, b in zip(times, times[1:]))


def test_debounce_counts_from_the_last_alert(spark, tmp_path):
    static, got = run(spark, tmp_path, lambda e: watch.debounced(e.filter("is_error"), "session_id", watch.DEBOUNCE_SECONDS))
    by = {}
    for r in static.filter("is_error").orderBy("ts").collect():
        own = by.setdefault(r.session_id, [])
        if not own or (r.ts - own[-1]).total_seconds() >= watch.DEBOUNCE_SECONDS:
            own.append(r.ts)
    assert sorted((r.session_id, r.ts) for r in got.collect()) == sorted((k, t) for k, v in by.items() for t in v)


def test_replay_of_many_shuffled_files(spark, tmp_path):
    rows = [(i % 5, i, 1704067200 + 300 * i, True) for i in range(2000)]
    df = spark.createDataFrame(rows, "session_id bigint, event_id bigint, at bigint, is_error boolean").select("session_id", "event_id", F.timestamp_seconds("at").alias("ts"), F.lit("x").alias("name"), "is_error")
    df.repartition(40, F.xxhash64("event_id")).write.parquet(str(tmp_path / "table"))
    shuffled = spark.read.parquet(str(tmp_path / "table"))
    assert len(shuffled.inputFiles()) > 30
    got = watch.replay(shuffled, lambda e: watch.debounced(e, "session_id", 3000), str(tmp_path / "replay"))
    want = [i for s in range(5) for i in range(s, 2000, 10)]
    assert sorted(r.event_id for r in got.collect()) == sorted(want)
    assert watch.replay(shuffled.limit(0), lambda e: watch.debounced(e, "session_id", 3000), str(tmp_path / "none")).count() == 0


def test_alerts(spark):
    pred = spark.createDataFrame([(1, "Bash", 0.8, 1), (1, "Read", 0.9, 2), (2, "Bash", 0.9, 1), (3, "Edit", 0.7, 1), (4, "Edit", 0.9, 1)], "query_id bigint, name string, freq double, rank int")
    used = spark.createDataFrame([(2, "bash"), (1, "Read")], "session_id bigint, name string")
    sizes = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 2)], "session_id bigint, turns bigint")
    assert [tuple(r) for r in watch.predict_alerts(pred, used, sizes).collect()] == [(1, "Bash", 0.8)]
    assert [tuple(r) for r in watch.primer_alerts(spark.createDataFrame([(1, 2), (1, 3), (2, 3), (2, 3)], "query_id bigint, id bigint")).collect()] == [(1, 2)]
    stuck = spark.createDataFrame([(1, 4), (9, 3)], "session_id bigint, recent_errors bigint")
    assert sorted(map(tuple, watch.loop_alerts(stuck, pred).collect())) == [(1, 4, "Bash", 0.8), (9, 3, None, None)]


def test_batch_forms(spark, tmp_path):
    static = events(spark, str(tmp_path / "in"))
    assert {r.session_id: r.event_id for r in watch.latest_errors(static).collect()} == {1: 139, 2: 239}
    assert watch.error_counts(static).agg(F.sum("n")).first()[0] == 28
    assert watch.error_bursts(static).count() == 2
