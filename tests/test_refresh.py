"""Refreshing: snapshot differences, replacement, file streams and event time."""

from datetime import datetime, timedelta

from spandrel.streaming import refresh as S

STATE = "path string, hash string, size long, mtime_ns long, recipe_version string"


def test_changes_and_replacement(spark):
    known = [("same", "h", 1, 1, "1"), ("touched", "h", 1, 1, "1"), ("edited", "h", 1, 1, "1"), ("stale", "h", 1, 1, "1"), ("gone", "h", 1, 1, "1"), ("empty", None, None, 5, None)]
    listed = [("same", "h", 1, 1, "1"), ("touched", "h", 1, 2, "1"), ("edited", "x", 2, 3, "1"), ("stale", "h", 1, 1, "2"), ("new", "h", 1, 1, "1")]
    got = S.changes(spark.createDataFrame(listed, STATE), spark.createDataFrame(known, STATE))
    said = {r.path: r.change for r in got.collect()}
    assert said == {"same": "same", "touched": "restamped", "edited": "changed", "stale": "stale", "gone": "deleted", "new": "new", "empty": "new"}
    table = spark.createDataFrame([(p, "old") for p in ("same", "touched", "edited", "stale", "gone")], "path string, v string")
    fresh = spark.createDataFrame([(p, "new") for p in ("edited", "stale", "new")], "path string, v string")
    out = {r.path: r.v for r in S.replace_paths(table, fresh, got).collect()}
    assert out == {"same": "old", "touched": "old", "edited": "new", "stale": "new", "new": "new"}
    none = spark.createDataFrame([], STATE)
    assert {r.change for r in S.changes(none, spark.createDataFrame(known[:1], STATE)).collect()} == {"deleted"} and S.changes(none, none).count() == 0


def test_latest_delivery(spark):
    rows = [("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", None, "n"), (None, 9, "q"), ("a", 3, "z")]
    df = spark.createDataFrame(rows, "path string, loaded_at int, hash string")
    assert {(r.path, r.hash) for r in S.latest(df).collect()} == {("a", "z"), ("b", "n")}


def test_files_are_handed_on_once(spark, tmp_path):
    folder, state, seen = tmp_path / "in", tmp_path / "state", []
    each = lambda df, n: seen.extend(r.id for r in df.collect())
    spark.range(3).coalesce(1).write.parquet(str(folder))
    for _ in range(2):
        S.watch(spark, str(folder), "id long", str(state), each).awaitTermination()
    assert sorted(seen) == [0, 1, 2]
    spark.range(7, 9).coalesce(1).write.mode("append").parquet(str(folder))
    S.watch(spark, str(folder), "id long", str(state), each).awaitTermination()
    assert sorted(seen) == [0, 1, 2, 7, 8]
    raw, got = tmp_path / "raw", []
    raw.mkdir()
    (raw / "a.py").write_text("x = 1\n")
    S.watch(spark, str(raw), "", str(tmp_path / "s2"), lambda df, n: got.extend(bytes(r.content) for r in df.collect()), "binaryFile").awaitTermination()
    assert got == [b"x = 1\n"]


def test_event_time_on_tables_and_streams(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(minutes=17 * i), i % 3, f"e{i % 2}", float(i)) for i in range(200)] + [(900, None, 1, "e0", 1.0)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    want = sorted(map(tuple, S.event_counts(events).collect()))
    assert sum(r[2] for r in want) == 200
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    got = sorted(map(tuple, S.stream_once(S.event_counts(stream), "windows", str(tmp_path / "c1"), "complete").collect()))
    assert got == want
    gaps = S.sessions(events, "60 minutes").collect()
    assert sum(r.n for r in gaps) == 200 and {r.user_id for r in gaps} == {0, 1, 2} and len(gaps) == 3
    assert len(S.sessions(events, "40 minutes").collect()) == 200
