from pyspark.sql import functions as F

from marquee.operators import manifest, scoring

from .test_recommend import small, weights  # noqa: F401


def test_words_of_any_number_of_bits(spark):
    got = spark.range(65).select("id", scoring._first_bits(F.col("id").cast("int")).alias("bits")).collect()
    assert {r.id: r.bits & (2**64 - 1) for r in got} == {n: 2**n - 1 for n in range(65)}  # 63 overflowed


def test_only_promising_rows_are_sorted_and_they_are_narrow(spark, small):  # noqa: F811
    users, _, facets, plays, prefs = small
    items = spark.range(1, 301).select(
        F.col("id").alias("item_id"), F.lit("n").alias("name"), F.lit("/m/x").alias("path"), F.lit("Movies").alias("category"), (F.col("id") % 50 / 5).alias("rating"),
        F.when(F.col("id") % 9 == 0, "Saga").alias("collection"), F.lit("").alias("album_artist"), F.array().cast("array<string>").alias("artists"),
    )
    cat = scoring.catalogue(items, plays)
    sure = scoring.with_sure(weights(spark, 1.2), cat)
    rows = scoring.with_terms(scoring.score_parts(users, items, facets, plays, prefs, cat=cat), sure).cache()
    every, some = rows.drop("sure_warm", "sure_cold"), scoring.promising(rows, 5)
    assert 3 * 5 <= some.count() < every.count() / 3
    best = lambda df: sorted((r.user_id, r.position, r.item_id, r.score) for r in scoring.top_n(scoring.qualify(df, 7), 5).collect())
    assert best(some) == best(every)
    found = scoring.recommend(users, items, facets, plays, prefs, weights(spark, 1.2), n=5)
    assert sorted((r.user_id, r.position, r.item_id, r.score) for r in found.collect()) == best(every)
    lines = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    window = next(x for x in lines if "Window [row_number()" in x and "user_id" in x)
    below = lines[lines.index(window) + 1]
    assert "path" not in below and "album_artist" not in below
    rows.unpersist()


def test_manifests_by_item_equal_those_by_row(spark):
    kind = "user_id long, user_name string, category string, item_id long, name string, path string, album_artist string, artists array<string>, is_folder boolean, position int"
    item = {5: ("Movies", 5, "Film: 1", "/m/f", "", [], True), 6: ("Movies", 6, "One", "/m/one.mkv", "", [], False), 7: ("Music", 7, "Album", "/s/al", "", ["Who?"], True), 8: ("Movies", 8, "Film 1", "/m/g", "", [], True), 9: ("Music", 9, "Other", "/s/o", "Who", [], True)}
    top = spark.createDataFrame([(u, n, *item[i], p) for u, n in ((1, "A/n"), (2, "An"), (3, None)) for p, i in enumerate((9, 5, 6, 7, 8) if u == 1 else (7, 5, 8, 9))], kind)
    files = spark.createDataFrame([(i, "", n, n.split(".")[-1]) for i in (5, 7, 8) for n in ("a.mkv", "a.mp4", "cover.jpg", "notes.txt")] + [(5, "s1", "e.x.ts", "ts")], "item_id long, rel_path string, file_name string, ext string")
    items = top.drop("user_id", "user_name", "position").distinct()
    lists = top.select("user_id", "user_name", "category", "item_id", "position")
    shown = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert shown(manifest.lists_manifest(lists, manifest.item_links(items, files))) == shown(manifest.link_manifest(top, files))
    assert shown(manifest.lists_docs(lists, manifest.item_docs(items))) == shown(manifest.sidecar_docs(top))
