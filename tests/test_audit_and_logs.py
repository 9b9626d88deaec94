import json
import os

import pytest
from pyspark.sql import functions as F

from marquee.operators import audit, logs, scoring
from marquee.sources import readers
from marquee.streaming import logs as stream


@pytest.fixture
def libraries(spark):
    rows = [
        ("r1", "Films", "movies", ["/media/films"], 0), ("d1", "Discover Movies\u200b", "movies", ["/srv/discovery/Ann/Movies"], 1), ("d2", "Discover Old", "movies", ["C:\\srv\\x", "/SRV/Discovery/Bob B/Shows"], 2),
        ("x", "Recommended stuff", "music", [], 3), ("z", None, None, None, 4), ("r2", "Tunes", "music", ["/media/tunes"], 5),
    ]
    return spark.createDataFrame(rows, readers.LIBRARIES + ", ordinal int")


@pytest.fixture
def users(spark):
    return spark.createDataFrame([("1", "Ann", 0, ["b", "a", "b", "x"], True), ("2", "Bob: B", 1, ["r1"], True), ("3", "", 2, None, True)], readers.USERS)


def test_libraries(spark, libraries):
    mapping = scoring.library_mapping(readers.default_categories(spark), libraries)
    assert {r.category: r.source_ids for r in mapping.collect()} == {"Movies": ["d1", "d2", "r1"], "Music": ["r2", "x"]}
    assert {r.item_id for r in audit.stale_libraries(libraries, mapping).collect()} == {"d2", "x"}
    assert {r.item_id for r in audit.garbage(libraries).collect()} == {"d1", "x"}
    assert {r.item_id: r.generated for r in audit.split_libraries(libraries, "/srv/Discovery").collect()} == {"r1": False, "d1": True, "d2": True, "r2": False}


def test_policies(spark, users, libraries):
    gone = spark.createDataFrame([("x",), (None,)], "item_id string")
    assert [(r.user_id, r.new_folders, r.removed_count) for r in audit.prune_deleted(users, gone).collect()] == [("1", ["b", "a", "b"], 1)]
    got = {r.user_id: (r.new_folders, r.removed_count) for r in audit.prune_ghosts(users, libraries).collect()}
    assert got == {"1": (["x"], 3)}
    with pytest.raises(ValueError):
        audit.prune_ghosts(users, libraries.where("false"))
    new = {r.user_id: (r.enabled_folders, r.enable_all, r.n_own) for r in audit.rebuild_policies(users, libraries, "/srv/discovery").collect()}
    assert new == {"1": (["r1", "r2", "d1"], False, 1), "2": (["r1", "r2", "d2"], False, 1), "3": (["r1", "r2"], False, 0)}
    assert {(r.user_id, r.n_real, r.n_own) for r in audit.visibility_summary(audit.rebuild_policies(users, libraries, "/srv/discovery")).collect()} == {("1", 2, 1), ("2", 2, 1), ("3", 2, 0)}


def test_collisions(spark):
    rows = spark.createDataFrame([(1, "A: b"), (2, "a B"), (3, "c")], "user_id long, name string")
    assert [tuple(r) for r in audit.name_collisions(rows, "user_id").collect()] == [("a b", 2, 1, 2)]


LINES = ["2024-01-01 [INFO] fine", "x ERROR y ERROR z", "2024-01-01 [ERROR] boom", "2024-01-02 [ERROR] boom", "Traceback (most recent)", "2024 [CRITICAL] end", "after"]


def test_logs(spark, tmp_path):
    for name, lines, when in (("one.log", LINES, 1_000_000), ("two.log", [f"line {i}" for i in range(150)], 2_000_000), ("no.txt", ["ERROR"], 3_000_000)):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        os.utime(tmp_path / name, (when, when))
    lines = readers.read_logs(spark, str(tmp_path))
    assert lines.groupBy("file").count().orderBy("file").collect() == [("one.log", 7), ("two.log", 150)]
    assert [(r.message, r.first_line) for r in logs.error_digest(lines).orderBy("position").collect()] == [("z", 1), ("] boom", 2), ("Traceback (most recent)", 4)]
    assert "boom" in [r.message for r in logs.error_digest(lines, clean=True).collect()]
    assert {r.file: (r.success, r.n_errors) for r in logs.run_status(lines).collect()} == {"one.log": (False, 5), "two.log": (True, 0)}
    tail = logs.log_tail(logs.latest_file(lines)).orderBy("line_no").collect()
    assert (len(tail), tail[0].line, tail[-1].line) == (100, "line 50", "line 149")
    query = stream.run_error_stream(spark, str(tmp_path / "*.log"), f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination(60)
    got = spark.read.parquet(f"{tmp_path}/out").select("file", "level", "message", "clean_message").collect()
    assert sorted(map(str, got)) == sorted(map(str, stream.errors(lines).collect()))


def test_last_plays_of_a_stream(spark, tmp_path):
    rows = [("e1", 1, 5, "2024-01-01 00:00:00"), ("e1", 1, 5, "2024-01-01 00:00:00"), ("e2", 1, 5, "2024-01-01 05:00:00"), ("e3", 2, 5, "2024-01-01 01:00:00")]
    kind = "event_id string, user_id long, item_id long, ts timestamp"
    spark.createDataFrame(rows, "event_id string, user_id long, item_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    plays = stream.last_plays(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"))
    query = plays.writeStream.format("memory").queryName("last_plays").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    query.awaitTermination(60)
    assert {(r.user_id, str(r.last_played)) for r in spark.table("last_plays").collect()} == {(1, "2024-01-01 05:00:00"), (2, "2024-01-01 01:00:00")}


def test_readers(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"SCORING": {"DISCOVERY_BIAS": {"Movies": {"genres": 9.0}, "Books": {"actors": 1.0}}}}))
    got = {r.category: r for r in readers.read_weights(spark, str(tmp_path / "w.json")).collect()}
    assert (got["Movies"].genres, got["Movies"].actors, got["Shows"].genres, got["Books"].actors, got["Books"].directors) == (9.0, 1.5, 1.5, 1.0, 2.5)
    (tmp_path / "bad.json").write_text("{")
    assert readers.read_weights(spark, str(tmp_path / "bad.json")).count() == 3
    assert readers.read_categories(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "c.json").write_text(json.dumps({"CATEGORIES": {"Movies": {"enabled": True, "discovery_name": "D", "min_community_score": 4}, "Odd": {"enabled": True}}}))
    assert [tuple(r) for r in readers.read_categories(spark, str(tmp_path / "c.json")).collect()] == [("Movies", True, "D", 4.0, "movies", "Movie")]
    (tmp_path / "l.json").write_text('{"item_id": "1", "name": "n", "locations": ["/a"]}\n')
    assert readers.read_libraries(spark, str(tmp_path / "l.json")).first().locations == ["/a"]
    (tmp_path / "v.json").write_text('{"item_id": "1", "name": "n", "type": "UserView"}\n{"item_id": "2", "name": "m", "type": "Movie"}\n')
    assert readers.read_view_items(spark, str(tmp_path / "v.json")).count() == 1
    (tmp_path / "p.json").write_text('{"user_id": "1", "item_id": "a", "last_played": "2024"}\n{"user_id": "1", "item_id": "b"}\n')
    assert [r.item_id for r in readers.read_plays(spark, str(tmp_path / "p.json"), 1).collect()] == ["a"]
    summary = spark.createDataFrame([("1", "A", 0, ["s"], True), ("2", "B", 1, ["t"], True)], readers.USERS)
    full = spark.createDataFrame([("1", "A", 0, ["f"], False)], readers.USERS)
    assert {r.user_id: (r.enabled_folders, r.enable_all) for r in readers.read_users(summary, full).collect()} == {"1": (["f"], False), "2": (["t"], True)}
    os.makedirs(tmp_path / "m" / "sub")
    (tmp_path / "m" / "sub" / "A.MKV").write_text("x")
    assert [(r.file_name, r.ext) for r in readers.read_files(spark, str(tmp_path / "m")).collect()] == [("A.MKV", "mkv")]
