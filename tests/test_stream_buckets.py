"""Keyed state of streams is held by few groups, with the results of a state for each key."""

from turnstone.streaming import watch


def test_few_groups_hold_the_states_of_all_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(watch, "BUCKETS", 4)
    rows = [(None if k == 7 else f"k{k}", k * 1000 + n, n * 1500 + k) for k in range(60) for n in range(30)]
    events = spark.createDataFrame(rows, "key string, event_id bigint, s bigint").selectExpr("key", "event_id", "timestamp_seconds(1704067200 + s) as ts")
    got = watch.replay(events, lambda e: watch.debounced(e, "key", 4000), str(tmp_path))
    want = {(None if k == 7 else f"k{k}", k * 1000 + n) for k in range(60) for n in range(0, 30, 3)}
    found = [(r.key, r.event_id) for r in got.collect()]
    assert set(found) == want and len(found) == len(want)
    assert 0 < spark.read.format("statestore").load(f"{tmp_path}/checkpoint").count() <= 4
