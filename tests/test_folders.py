import datetime
import os

import pytest
from pyspark.sql import functions as F

from marquee.operators import folders, manifest
from marquee.plans.fixtures import Library
from marquee.sources import readers


def under(spark, paths, items, **more):
    files = spark.createDataFrame([(p, p.replace("\\", "/").split("/")[-1] if p else None, "x") for p in paths], "path string, file_name string, ext string")
    return {(r.item_id, r.rel_path, r.file_name) for r in folders.files_under_items(files, spark.createDataFrame(items, "item_id long, path string"), **more).collect()}


def test_files_belong_to_the_deepest_item(spark):
    items = [(1, "/m/show"), (2, "/m/show/s1/"), (3, "/m/show/s1/e1.mkv"), (4, "/m/sh"), (5, None), (6, ""), (7, "C:\\media\\film"), (8, "/m/show/s1")]
    paths = ["/m/show/a.mkv", "/m/show/s1/e1.mkv", "/m/show/s1/e2.mkv", "/m/show/s1/x/y/e3.mkv", "/m/show2/b.mkv", "file:/m/show/c.mkv", "C:\\media\\film\\cd1\\f.avi", "/other/d.mkv", None, "e.mkv"]
    deepest = under(spark, paths, items)
    assert deepest == {(1, "", "a.mkv"), (3, "", "e1.mkv"), (2, "", "e2.mkv"), (8, "", "e2.mkv"), (2, "x/y", "e3.mkv"), (8, "x/y", "e3.mkv"), (1, "", "c.mkv"), (7, "cd1", "f.avi")}
    walked = under(spark, paths, items, deepest=False)
    assert walked == deepest | {(1, "s1", "e1.mkv"), (2, "", "e1.mkv"), (8, "", "e1.mkv"), (1, "s1", "e2.mkv"), (1, "s1/x/y", "e3.mkv")}
    assert under(spark, paths, []) == set() == under(spark, [], items)


@pytest.mark.parametrize("deepest", [True, False])
def test_files_and_items_are_never_broadcast(spark, deepest):
    files = spark.createDataFrame([("/m/show/a.mkv", "a.mkv", "mkv")], "path string, file_name string, ext string")
    found = folders.files_under_items(files, spark.createDataFrame([(1, "/m/show")], "item_id long, path string"), deepest)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_manifest_broadcasts_no_files(spark):
    files = spark.createDataFrame([(1, "", "a.mkv", "mkv")], "item_id long, rel_path string, file_name string, ext string")
    lists = spark.createDataFrame([(1, "Ann", "Movies", 1, "One", "/m/one", "", ["Z"], True)], "user_id long, user_name string, category string, item_id long, name string, path string, album_artist string, artists array<string>, is_folder boolean")
    assert "Broadcast" not in manifest.link_manifest(lists, files)._jdf.queryExecution().executedPlan().toString()


def test_inventory_of_a_folder_to_manifest(spark, tmp_path):
    for name in ("films/One/One.mkv", "films/One/extras/e.mp4", "films/One/poster.JPG", "films/Two/Two.avi", "stray.mkv"):
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_text("x")
    items = spark.createDataFrame([(1, "One", f"{tmp_path}/films/One", True, 1), (2, "Two", f"{tmp_path}/films/Two", True, 2)], "item_id long, name string, path string, is_folder boolean, position int")
    files = folders.files_under_items(readers.read_files(spark, str(tmp_path)), items)
    lists = items.selectExpr("*", "1L AS user_id", "'Ann' AS user_name", "'Movies' AS category", "'' AS album_artist", "array('Z') AS artists")
    got = {r.target: (r.action, r.source) for r in manifest.link_manifest(lists, files).collect()}
    assert got == {
        "Ann/Movies/One/One.strm": ("strm", f"{tmp_path}/films/One/One.mkv"), "Ann/Movies/One/extras/e.strm": ("strm", f"{tmp_path}/films/One/extras/e.mp4"),
        "Ann/Movies/One/poster.JPG": ("copy", f"{tmp_path}/films/One/poster.JPG"), "Ann/Movies/Two/Two.strm": ("strm", f"{tmp_path}/films/Two/Two.avi"),
    }


TOP = "user_id long, category string, position int, item_id long, name string, path string, album_artist string, artists array<string>, is_folder boolean"


@pytest.fixture
def shared(spark):
    users = spark.createDataFrame([(1, "A/n", 0), (2, "An", 1), (3, "Bo", 2), (4, "A:n", 3)], "user_id long, name string, ordinal int")
    top = spark.createDataFrame(
        [(1, "Music", 1, 7, "Album", "/s/al", "", ["First"], True), (2, "Music", 1, 7, "Album", "/s/al", "", ["First"], True), (2, "Music", 2, 8, "Album!", "/s/other", "First", [], True), (1, "Movies", 1, 5, "Film", "/m/f", "", [], True), (2, "Movies", 1, 6, "One", "/m/one.mkv", "", [], False), (3, "Movies", 1, 6, "One", "/m/one.mkv", "", [], False)],
        TOP,
    )
    files = spark.createDataFrame([(i, "", n, n.split(".")[-1]) for i in (5, 7, 8) for n in ("a.mkv", "cover.jpg", "album.nfo")], "item_id long, rel_path string, file_name string, ext string")
    return users, top, files


def targets(df):
    rows = df.collect()
    assert len({r.target for r in rows}) == len(rows)  # one row a target
    return {r.target: (r.action, r.source or r.doc) for r in rows}


def test_last_served_owns_a_folder(spark, shared):
    users, top, files = shared
    served = top.select("user_id", "category").unionByName(spark.createDataFrame([(4, "Movies")], "user_id long, category string"))
    owners = folders.folder_owners(users, served)
    assert {(r.folder, r.category, r.user_id) for r in owners.collect()} == {("An", "Music", 2), ("An", "Movies", 4), ("Bo", "Movies", 3)}
    got = targets(folders.owned_targets(top, owners, files))
    assert got == {  # user 4 was served and qualified for nothing, so the films of 1 and 2 are gone
        "An/Music/First/Album/a.mkv": ("link", "/s/other/a.mkv"), "An/Music/First/Album/cover.jpg": ("copy", "/s/al/cover.jpg"),  # the later link, the first copy
        "An/Music/First/Album/album.nfo": ("write", "<album><title>Album</title><artist>First</artist></album>"), "An/Music/First/artist.nfo": ("write", "<artist><name>First</name></artist>"),
        "Bo/Movies/One/one.mkv.strm": ("strm", "/m/one.mkv"),
    }


def test_changes_between_runs(spark, shared):
    users, top, files = shared
    first = top.where("user_id <> 2")
    owners = folders.folder_owners(users, first)
    empty = spark.createDataFrame([], folders.STATE)
    new = folders.owned_targets(first, owners, files)
    changes = folders.target_changes(new, empty, owners)
    assert {r.change for r in changes.collect()} == {"create"} and changes.count() == new.count()
    state = folders.with_changes(empty, changes)
    assert folders.target_changes(new, state, owners).count() == 0  # the same run again
    assert targets(folders.with_changes(state, changes)) == targets(state)  # applied twice
    # user 2 takes over both folders of An; that of Bo isn't written and stays
    second = top.where("user_id = 2")
    owners2 = folders.folder_owners(users, second)
    later = folders.target_changes(folders.owned_targets(second, owners2, files), state, owners2)
    got = {(r.change, r.target) for r in later.collect()}
    assert ("delete", "An/Movies/Film/a.strm") in got and ("create", "An/Movies/One/one.mkv.strm") in got and ("replace", "An/Music/First/Album/a.mkv") in got
    assert not any(t.startswith("Bo/") for _, t in got) and ("replace", "An/Music/First/artist.nfo") not in got
    after = folders.with_changes(state, later)
    assert set(targets(after)) == set(targets(folders.owned_targets(second, owners2, files))) | {"Bo/Movies/One/one.mkv.strm"}
    assert folders.target_changes(folders.owned_targets(second, owners2, files), after, owners2).count() == 0


def test_plan_joins_folders_not_files(spark):
    files = spark.range(1000).select(F.concat(F.lit("/m/i"), (F.col("id") % 10).cast("string"), F.lit("/f"), F.col("id").cast("string")).alias("path"), F.lit("f").alias("file_name"), F.lit("x").alias("ext"))
    items = spark.range(10).select(F.col("id").alias("item_id"), F.concat(F.lit("/m/i"), F.col("id").cast("string")).alias("path"))
    found = folders.files_under_items(files, items)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and found.count() == 1000


def test_lists_of_items_with_ids_above_a_million(spark, tmp_path):
    tables = {
        "part": ([(1, "a b", "SMALL X", 5, "B1"), (1_000_001, "c d", "SMALL X", 5, "B1")], "p_partkey long, p_name string, p_type string, p_size int, p_brand string"),
        "orders": ([(1, 7, "O", datetime.datetime(2000, 1, 1)), (2, 8, "O", datetime.datetime(2000, 1, 1))], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp"),
        "lineitem": ([(1, 1, 1, 1), (2, 1_000_001, 1, 1)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"),
    }
    for name, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert {(r.user_id, r.item_id, r.position) for r in Library(spark, str(tmp_path)).play_lists().collect()} == {(7, 1, 1), (8, 1_000_001, 1)}
