import pytest
from pyspark.sql import functions as F

from marquee.operators import manifest, profile, scoring, sinks
from marquee.sources import readers

AS_OF = "2024-06-01 00:00:00"


@pytest.fixture
def small(spark):
    users = spark.createDataFrame([(1, "Ann", 0), (2, "Bob", 1), (3, "Cy", 2)], "user_id long, name string, ordinal int")
    items = spark.createDataFrame(
        [(i, f"m{i}", f"/m/{i}", "Movies", 3.0, None, "", []) for i in range(1, 6)]
        + [(10, "hit", "/m/10", "Movies", None, "Saga", "", []), (11, "nopath", None, "Movies", 9.0, None, "", []), (12, "low", "/m/12", "Movies", 0.0, None, "", []), (13, "high", "/m/13", "Movies", 3.0, None, "", [])]
        + [(20, "song", "/s/20", "Music", None, None, "", ["Z"])],
        "item_id long, name string, path string, category string, rating double, collection string, album_artist string, artists array<string>",
    ).withColumn("collection", F.when(F.col("item_id") == 1, "Saga").otherwise(F.col("collection")))
    genres = spark.createDataFrame([(1, "g"), (1, "g"), (2, "h"), (10, "g"), (10, "x")], "item_id long, genre string")
    people = spark.createDataFrame([(1, "p", "Actor"), (1, "p", "Director"), (10, "p", "Actor"), (10, "p", "Actor"), (10, "q", "Writer"), (1, "q", "Writer")], "item_id long, person string, type string")
    plays = spark.createDataFrame([(1, i, "2024-05-30 00:00:00") for i in range(1, 6)] + [(2, i, None) for i in range(1, 5)], "user_id long, item_id long, last_played string").withColumn("last_played", F.col("last_played").try_cast("timestamp_ntz"))
    facets = profile.facets(genres, people)
    return users, items, facets, plays, profile.accumulate(plays, facets, AS_OF)


def test_profile(spark, small):
    users, items, facets, plays, prefs = small
    got = {(r.user_id, r.facet, r.value): (r.num, r.pref) for r in profile.normalise(prefs).collect()}
    assert got[1, "genre", "g"] == (30, 1.0) and got[1, "genre", "h"] == (15, 0.5)  # twice on one item counts twice
    assert got[1, "actor", "p"] == (30, 1.0) and got[1, "director", "p"] == (60, 1.0)
    assert got[2, "genre", "g"] == (14, 1.0) and not any(k[2] == "q" for k in got)
    assert {(r.user_id, r.collection) for r in profile.user_collections(plays, items).collect()} == {(1, "Saga"), (2, "Saga")}
    assert {r.user_id: (r.n_plays, r.warm) for r in profile.warmth(users, plays).collect()} == {1: (5, True), 2: (4, False), 3: (0, False)}


def weights(spark, diversity=0.0):
    w = readers.default_weights(spark).withColumn("diversity", F.lit(diversity))
    return scoring.weights_for(readers.default_categories(spark), w)


def test_scores(spark, small):
    users, items, facets, plays, prefs = small
    rows = scoring.qualify(scoring.with_terms(scoring.score_parts(users, items, facets, plays, prefs), weights(spark)), 7)
    got = {(r.user_id, r.item_id): r.score for r in rows.collect()}
    # warm: default 5 + genre 1 * 1 + actor twice 1 * 1.5 + collection 5
    assert got[1, 10] == 5.0 + 1.0 + 3.0 + 5.0
    assert got[1, 12] == 5.0 and (1, 13) not in got and got[1, 20] == 7.0
    # cold: rating + 2 reaches 5; unrated films get nothing; unrated music is drawn
    assert got[2, 13] == 5.0 and (2, 10) not in got and (2, 12) not in got
    assert 6.5 <= got[2, 20] <= 9.5
    assert not any(i == 11 for _, i in got) and (1, 1) not in got
    seen = scoring.with_terms(scoring.score_parts(users, items, facets, plays, prefs, include_played=True), weights(spark)).where("user_id = 1 AND item_id = 2").first()
    assert seen.penalty == 10.0


def test_top_is_stable_and_bounded(spark, small):
    users, items, facets, plays, prefs = small
    args = users, items, facets, plays, prefs, weights(spark, 1.2)
    first = scoring.recommend(*args, n=2).select("user_id", "category", "position", "item_id", "score").collect()
    again = scoring.recommend(*[a.repartition(3) for a in args], n=2).select("user_id", "category", "position", "item_id", "score").collect()
    assert sorted(first) == sorted(again) and max(r.position for r in first) == 2
    other = scoring.recommend(*args, seed=8).select("score").collect()
    assert sorted(other) != sorted(scoring.recommend(*args, seed=7).select("score").collect())


def test_candidates_are_each_users_first_unplayed(spark, small):
    users, items, _, plays, _ = small
    got = {}
    for r in scoring.candidates(users, items, plays, limit=3).orderBy("item_id").collect():
        got.setdefault((r.user_id, r.category), []).append(r.item_id)
    assert got[1, "Movies"] == [10, 11, 12] and got[2, "Movies"] == [5, 10, 11] and got[3, "Movies"] == [1, 2, 3]


def test_plan_has_one_place_for_a_user(spark, small):
    users, items, facets, plays, prefs = small
    before = set(spark.sparkContext._jsc.getPersistentRDDs())  # what other tests hold
    run = scoring.recommend(users, items, facets, plays, prefs, weights(spark))._jdf.queryExecution()
    plan = run.executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "WindowGroupLimit" in plan
    # hits are kept only where they are candidates, before they are summed
    lines = run.optimizedPlan().toString().split("\n")
    kept = [i for i, x in enumerate(lines) if "shiftright(" in x and "wanted" in x and ("Filter" in x or "Join" in x)]
    summed = [i for i, x in enumerate(lines) if "sum(genre_num" in x]
    assert kept and summed and min(summed) < min(kept)
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= before


def test_items_of_the_source_libraries_and_types_only(spark):
    mapping = spark.createDataFrame([("Movies", "Movie", ["l1", "l2"]), ("Shows", "Series", ["l2"])], "category string, item_type string, source_ids array<string>")
    items = spark.createDataFrame([(1, "l1", "Movie"), (2, "l1", "Series"), (3, "l2", "Series"), (4, "l3", "Movie"), (5, "l2", "Movie"), (6, None, "Movie")], "item_id long, library_id string, item_type string")
    assert {(r.item_id, r.category) for r in scoring.source_items(items, mapping).collect()} == {(1, "Movies"), (3, "Shows"), (5, "Movies")}


def test_weights_without_a_row(spark):
    default = {r.category: r for r in weights(spark).collect()}
    own = readers.default_weights(spark).where("category = 'Music'")
    got = {r.category: r for r in scoring.weights_for(readers.default_categories(spark), own).collect()}
    assert set(got) == {"Movies", "Shows", "Music"} and got["Shows"].genres == got["Movies"].genres == 1.0 and got["Music"].genres == 2.0
    assert got["Shows"].actors == default["Movies"].actors and got["Shows"].discovery_name == "Discover Shows"
    half = own.withColumn("category", F.lit("Movies")).withColumn("genres", F.lit(None).cast("double"))
    assert {r.genres for r in scoring.weights_for(readers.default_categories(spark), half).collect()} == {1.0}


def test_broadcasts_are_bounded_by_bytes(spark):
    wide = spark.range(100).selectExpr("id", "repeat('x', 1000) AS text", "array(id, id) AS pair")
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()
    small, none = wide.limit(10), wide.where("false")
    assert [hinted(df) for df in scoring.bounded(wide, small, none, most=200_000)] == [True, True, True]
    assert [hinted(df) for df in scoring.bounded(wide, small, none, most=100_000)] == [False, True, True]


def test_plays_are_capped_to_the_latest(spark):
    plays = spark.createDataFrame([(1, 1, "2024-01-01"), (1, 2, "2024-01-03"), (1, 3, None), (2, 9, None)], "user_id long, item_id long, last_played string")
    assert {(r.user_id, r.item_id) for r in readers.cap_plays(plays, 2).collect()} == {(1, 2), (1, 1), (2, 9)}


def test_manifest(spark):
    top = spark.createDataFrame(
        [(1, "A/n", "Movies", 5, "Film: 1", "/m/f", "", [], True, 1), (1, "A/n", "Movies", 6, "One", "/m/one.mkv", "", [], False, 2), (1, "A/n", "Music", 7, "Album", "/s/al", "", ["Who?"], True, 1), (2, "An", "Music", 7, "Album", "/s/al", "", ["Who?"], True, 1)],
        "user_id long, user_name string, category string, item_id long, name string, path string, album_artist string, artists array<string>, is_folder boolean, position int",
    )
    files = spark.createDataFrame([(i, "", n, n.split(".")[-1]) for i in (5, 7) for n in ("a.mkv", "a.mp4", "cover.jpg", "notes.txt")] + [(5, "s1", "e.x.ts", "ts")], "item_id long, rel_path string, file_name string, ext string")
    got = {(r.user_id, r.target): (r.action, r.source, r.n_sources) for r in manifest.link_manifest(top, files).collect()}
    assert got[1, "An/Movies/Film 1/a.strm"] == ("strm", "/m/f/a.mp4", 2)
    assert got[1, "An/Movies/Film 1/cover.jpg"] == ("copy", "/m/f/cover.jpg", 1)
    assert got[1, "An/Movies/Film 1/s1/e.x.strm"][1] == "/m/f/s1/e.x.ts"
    assert got[1, "An/Movies/One/one.mkv.strm"] == ("strm", "/m/one.mkv", 1)
    assert got[1, "An/Music/Who/Album/a.mkv"][0] == "link" and not any("notes" in k[1] for k in got)
    more = files.unionByName(spark.createDataFrame([(7, "", "album.nfo", "nfo"), (7, "", "other.nfo", "nfo")], files.schema))
    links, made = manifest.outputs(top, more)
    targets = {r.target for r in links.collect()}
    assert "An/Music/Who/Album/other.nfo" in targets and not targets & {r.target for r in made.collect()}
    docs = {r.target: r.doc for r in manifest.sidecar_docs(top).collect()}
    assert docs == {"An/Music/Who/Album/album.nfo": "<album><title>Album</title><artist>Who</artist></album>", "An/Music/Who/artist.nfo": "<artist><name>Who</name></artist>"}


def test_publish_keeps_and_empties(spark, tmp_path):
    kind = "user_id long, category string, item_id long"
    old = spark.createDataFrame([(1, "Movies", 1), (2, "Movies", 2), (3, "Movies", 3)], kind)
    sinks.publish(old, old, None, f"{tmp_path}/p", "1")
    new = spark.createDataFrame([(1, "Movies", 9)], kind)
    served = spark.createDataFrame([(1, "Movies"), (2, "Movies")], "user_id long, category string")  # 2 qualified for nothing, 3 had no candidates
    sinks.publish(new, served, sinks.read_published(spark, f"{tmp_path}/p"), f"{tmp_path}/p", "2")
    assert {(r.user_id, r.item_id) for r in sinks.read_published(spark, f"{tmp_path}/p").collect()} == {(1, 9), (3, 3)}
    sinks.publish(new.where("false"), old, sinks.read_published(spark, f"{tmp_path}/p"), f"{tmp_path}/p", "3")  # all lists are empty
    assert set(sinks.read_published(spark, f"{tmp_path}/p").columns) == {"user_id", "item_id", "category"} and sinks.read_published(spark, f"{tmp_path}/p").count() == 0
    sinks.publish(new, served, sinks.read_published(spark, f"{tmp_path}/p"), f"{tmp_path}/p", "4")
    assert sinks.read_published(spark, f"{tmp_path}/p").count() == 1
    sinks.save_preferences(old, f"{tmp_path}/prefs", "2024-01-01")
    assert spark.read.parquet(f"{tmp_path}/prefs").where("run_date = '2024-01-01'").count() == 3
