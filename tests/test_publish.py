import os
import time

import pytest
from pyspark.sql import functions as F

from marquee.operators import sinks

KIND = "user_id long, category string, item_id long"


def lists(spark, rows):
    return spark.createDataFrame(rows, KIND)


def seen(spark, path, **more):
    return {tuple(r) for r in sinks.read_buckets(spark, path, KIND, **more).collect()}


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path)
    assert seen(spark, path) == set()
    first = [(u, c, 10 * u) for u in range(200) for c in ("Movies", "TV / Shows", "Müsic")]
    sinks.publish_buckets(lists(spark, first), lists(spark, first), path, "run1", buckets=16)
    assert seen(spark, path) == set(first)
    before = files(f"{path}/data")
    time.sleep(0.05)
    new = [(5, "Movies", 99), (5, "Movies", 98)]
    served = lists(spark, [*new, (7, "Müsic", 0)])  # 7 has candidates but nothing qualifies
    sinks.publish_buckets(lists(spark, new), served, path, "run2", buckets=16)
    expected = {r for r in first if r[:2] not in ((5, "Movies"), (7, "Müsic"))} | set(new)
    assert seen(spark, path) == expected
    after = files(f"{path}/data")
    assert before.items() <= after.items()  # files of the first run are as they were
    fresh = {f.split("/")[-2] for f in after.keys() - before.keys()}
    assert len(fresh) == 2  # the buckets of (Movies, 5) and (Müsic, 7), and no other
    assert seen(spark, path, run_id="run1") == set(first)
    assert sinks.expire_buckets(spark, path) == 3 and seen(spark, path) == expected  # two buckets and a commit
    everyone = lists(spark, first)
    sinks.publish_buckets(everyone.where("false"), everyone, path, "run3", buckets=16)
    assert seen(spark, path) == set()
    sinks.publish_buckets(lists(spark, new), lists(spark, new), path, "run4", buckets=16)
    assert seen(spark, path) == set(new)
    with pytest.raises(ValueError, match="not later"):
        sinks.publish_buckets(everyone, everyone, path, "run4")


def test_a_run_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    first, second = [(1, "Movies", 1), (2, "Movies", 2)], [(1, "Movies", 9)]
    sinks.publish_buckets(lists(spark, first), lists(spark, first), path, "1")

    def dies(*_):
        raise KeyboardInterrupt

    commit = sinks._commit
    monkeypatch.setattr(sinks, "_commit", dies)  # all data is written by then
    with pytest.raises(KeyboardInterrupt):
        sinks.publish_buckets(lists(spark, second), lists(spark, second), path, "2")
    assert seen(spark, path) == set(first)
    broken = lists(spark, second).withColumn("item_id", F.when(F.rand() >= 0, F.raise_error(F.lit("lost"))).otherwise(F.col("item_id")))
    with pytest.raises(Exception, match="lost"):  # it dies while it writes
        sinks.publish_buckets(broken, lists(spark, second), path, "2")
    assert seen(spark, path) == set(first)
    monkeypatch.setattr(sinks, "_commit", commit)
    commit(sinks._pointers(spark, path, "1"), path, "1x")
    os.remove(f"{path}/_commits/run_id=1x/_SUCCESS")  # it dies while it commits
    assert sinks.latest_commit(spark, path) == "1" and seen(spark, path) == set(first)
    sinks.publish_buckets(lists(spark, second), lists(spark, second), path, "2")  # the same run again
    assert seen(spark, path) == {(1, "Movies", 9), (2, "Movies", 2)}


def test_runs_at_the_same_time(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    rows = [(1, "Movies", 1)]
    latest, calls = sinks.latest_commit, []

    def other_run_first(*args):
        calls.append(1)
        if len(calls) == 2:  # before the commit
            sinks._commit(sinks._pointers(spark, path, None), path, "0")
        return latest(*args)

    monkeypatch.setattr(sinks, "latest_commit", other_run_first)
    with pytest.raises(RuntimeError, match="another run"):
        sinks.publish_buckets(lists(spark, rows), lists(spark, rows), path, "1")


def test_snapshots_and_writers(spark, tmp_path):
    prefs = spark.createDataFrame([(1, "genre", "g", 15)], "user_id long, facet string, value string, num long")
    for day in ("2024-01-01", "2024-01-02"):
        sinks.save_preferences(prefs.withColumn("value", F.lit(day)), f"{tmp_path}/p", day)
    assert [(r.value, r.run_date) for r in sinks.read_preferences(spark, f"{tmp_path}/p").collect()] == [("2024-01-02", "2024-01-02")]
    assert sinks.read_preferences(spark, f"{tmp_path}/p", "2024-01-01").first().value == "2024-01-01"
    sinks.write_feed(prefs, f"{tmp_path}/feed")
    sinks.write_feed(prefs.where("false"), f"{tmp_path}/feed")
    assert spark.read.parquet(f"{tmp_path}/feed").count() == 0
    docs = spark.createDataFrame([("a/b.nfo", "<x/>")], "target string, doc string")
    sinks.write_documents(docs, f"{tmp_path}/docs")
    assert spark.read.parquet(f"{tmp_path}/docs").collect() == docs.collect()
