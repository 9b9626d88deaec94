"""All registered queries of the library, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audit, exact, folders, logs, manifest, policies, profile, scoring, sinks
from ..sources import log_files, readers
from ..streaming import logs as stream_logs
from ..streaming import profiles as stream_profiles
from .fixtures import AS_OF, EVENTS_AS_OF, ROOT, Library, shared_path

SEED, TOP = 7, scoring.TOP
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(f: Callable[[Library], DataFrame]) -> Callable[[Library], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Library(spark, sf_dir))
    return f


Z = "chr(8203)"
BASE = f"""
users AS (SELECT c_custkey AS user_id, c_name AS name, CAST(c_custkey AS INTEGER) AS ordinal,
    ['lib' || (c_custkey % 25), 'lib' || ((c_custkey + 7) % 30), 'lib' || (c_custkey % 25)] AS enabled_folders FROM customer),
items AS (SELECT *, CASE WHEN item_id % 11 <> 0 THEN '/media/' || category || '/' || name || '-' || item_id || CASE WHEN item_id % 5 = 0 THEN '.mkv' ELSE '' END END AS path
    FROM (SELECT p_partkey AS item_id, p_name AS name,
        CASE WHEN split_part(p_type, ' ', 1) IN ('ECONOMY', 'LARGE') THEN 'Movies' WHEN split_part(p_type, ' ', 1) IN ('MEDIUM', 'PROMO') THEN 'Shows' ELSE 'Music' END AS category,
        CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS DOUBLE) / 5.0 END AS rating, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS collection,
        CASE WHEN p_partkey % 2 = 0 AND p_brand <> '' THEN p_brand WHEN p_partkey % 4 = 1 THEN p_type ELSE 'Unknown' END AS artist FROM part)),
genres AS (SELECT p_partkey AS item_id, split_part(p_name, ' ', 1) AS genre FROM part UNION ALL SELECT p_partkey, split_part(p_name, ' ', 2) FROM part),
people AS (SELECT DISTINCT l_partkey AS item_id, CAST(l_suppkey AS VARCHAR) AS person, CASE WHEN l_linenumber = 1 THEN 'Director' WHEN l_linenumber <= 3 THEN 'Actor' ELSE 'Writer' END AS type FROM lineitem WHERE l_linenumber <= 4),
plays AS (SELECT o_custkey AS user_id, l_partkey AS item_id, max(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END) AS last_played
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 1 GROUP BY ALL),
facets AS (SELECT item_id, 'genre' AS facet, genre AS value, 1 AS weight FROM genres
    UNION ALL SELECT item_id, lower(type), person, CASE type WHEN 'Actor' THEN 2 ELSE 4 END FROM people WHERE type IN ('Actor', 'Director')),
prefs AS (SELECT user_id, facet, value, CAST(sum(weight * tenths) AS BIGINT) AS num FROM
    (SELECT user_id, item_id, CASE WHEN last_played IS NULL THEN 7 WHEN d < 30 THEN 15 WHEN d < 90 THEN 10 WHEN d < 365 THEN 6 ELSE 3 END AS tenths
     FROM (SELECT *, datesub('day', last_played, TIMESTAMP '{AS_OF}') AS d FROM plays)) JOIN facets USING (item_id) GROUP BY user_id, facet, value),
maxima AS (SELECT user_id, facet, max(num) AS max_num FROM prefs GROUP BY user_id, facet),
liked AS (SELECT DISTINCT user_id, collection FROM plays JOIN items USING (item_id) WHERE collection IS NOT NULL AND collection <> ''),
warm AS (SELECT u.user_id, CAST(count(p.item_id) AS BIGINT) AS n_plays, count(p.item_id) >= 5 AS warm FROM users u LEFT JOIN plays p ON u.user_id = p.user_id GROUP BY u.user_id),
categories AS (SELECT * FROM (VALUES ('Movies', 'Discover Movies', 5.0, 'movies', 1.0, 1.5, 2.5, 5.0, 10.0, 1.2), ('Shows', 'Discover Shows', 5.0, 'tvshows', 1.5, 2.0, 1.0, 3.0, 6.0, 1.0),
    ('Music', 'Discover Music', 0.0, 'music', 2.0, 0.0, 0.0, 2.0, 4.0, 0.8)) AS t(category, discovery_name, min_score, api_type, genres, actors, directors, collection_weight, seen_penalty, diversity)),
libraries AS (SELECT 'lib' || n_nationkey AS item_id, CASE n_nationkey % 5 WHEN 0 THEN n_name WHEN 1 THEN 'Discover Movies' || {Z} WHEN 2 THEN 'Discover Old' WHEN 3 THEN 'Recommended X' ELSE 'Plain ' || n_name END AS name,
    CASE n_nationkey % 3 WHEN 0 THEN 'movies' WHEN 1 THEN 'tvshows' ELSE 'music' END AS collection_type,
    CASE n_nationkey % 5 WHEN 0 THEN ['/media/' || n_name] WHEN 4 THEN CAST([] AS VARCHAR[]) ELSE ['/SRV/Discovery/Customer' || lpad(CAST(n_nationkey * 3 AS VARCHAR), 9, '0') || '/Movies'] END AS locations, n_nationkey AS ordinal FROM nation)
"""
CANDIDATES = "cand AS (SELECT user_id, category, item_id, cat_rank FROM (SELECT u.user_id, i.category, i.item_id, i.cat_rank, row_number() OVER (PARTITION BY u.user_id, i.category ORDER BY i.item_id) AS n FROM users u CROSS JOIN (SELECT *, row_number() OVER (PARTITION BY category ORDER BY item_id) AS cat_rank FROM items) i LEFT JOIN plays p ON u.user_id = p.user_id AND i.item_id = p.item_id WHERE p.item_id IS NULL) WHERE n <= 600)"
HITS = "hits AS (SELECT c.user_id, c.item_id, " + ", ".join(f"sum(CASE WHEN p.facet = '{f}' THEN p.num ELSE 0 END) AS {f}_num" for f in ("genre", "actor", "director")) + " FROM cand c JOIN facets f ON c.item_id = f.item_id JOIN prefs p ON p.user_id = c.user_id AND p.facet = f.facet AND p.value = f.value GROUP BY c.user_id, c.item_id)"
PARTS = (
    "parts AS (SELECT c.user_id, c.item_id, c.category, i.name, i.path, i.rating, i.artist, w.warm, k.* EXCLUDE (category), "
    + ", ".join(f"CASE WHEN w.warm AND coalesce(h.{f}_num, 0) > 0 THEN CAST(h.{f}_num AS DOUBLE) / CAST(m{f}.max_num AS DOUBLE) * k.{f}s ELSE 0.0 END AS {f}_part" for f in ("genre", "director", "actor"))
    + ", CASE WHEN w.warm AND l.collection IS NOT NULL THEN k.collection_weight ELSE 0.0 END AS collection_part FROM cand c JOIN items i ON c.item_id = i.item_id JOIN warm w ON c.user_id = w.user_id JOIN categories k ON c.category = k.category LEFT JOIN hits h ON c.user_id = h.user_id AND c.item_id = h.item_id "
    + " ".join(f"LEFT JOIN maxima m{f} ON m{f}.user_id = c.user_id AND m{f}.facet = '{f}'" for f in ("genre", "director", "actor"))
    + " LEFT JOIN liked l ON l.user_id = c.user_id AND l.collection = i.collection)"
)
_U = lambda draw: f"(CAST(CAST('0x' || substr(md5(concat_ws('|', '{SEED}', '{draw}', CAST(user_id AS VARCHAR), CAST(item_id AS VARCHAR))), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0)"
_BASE_SCORE = lambda draw: f"CASE WHEN warm THEN CASE WHEN coalesce(rating, 0.0) > 0 THEN rating WHEN category = 'Music' THEN CAST(7.0 AS DOUBLE) ELSE CAST(5.0 AS DOUBLE) END ELSE CASE WHEN coalesce(rating, 0.0) > 0 THEN rating + CAST(2.0 AS DOUBLE) WHEN category = 'Music' THEN CAST(6.5 AS DOUBLE) + CAST(3.0 AS DOUBLE) * {_U(2 * draw + 1)} ELSE CAST(0.0 AS DOUBLE) END END"
_SCORE = lambda draw: f"({_BASE_SCORE(draw)} + genre_part + director_part + actor_part + collection_part - CAST(0.0 AS DOUBLE) + {_U(2 * draw)} * CAST(diversity AS DOUBLE))"
TOPS = f"tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, category ORDER BY score DESC, item_id) AS position FROM (SELECT *, {_SCORE(1)} AS score FROM parts WHERE path IS NOT NULL AND path <> '' AND {_SCORE(0)} >= min_score)) WHERE position <= {TOP})"
CATEGORY_FIX = BASE.replace("SELECT * FROM (VALUES", "SELECT category, discovery_name, CAST(min_score AS DOUBLE) AS min_score, api_type, CAST(genres AS DOUBLE) AS genres, CAST(actors AS DOUBLE) AS actors, CAST(directors AS DOUBLE) AS directors, CAST(collection_weight AS DOUBLE) AS collection_weight, CAST(diversity AS DOUBLE) AS diversity FROM (VALUES")
_SAFE = lambda c: f"trim(substring(trim(regexp_replace({c}, '[^\\p{{L}}\\p{{N}} _-]', '', 'g')), 1, 50))"


def _sql(name: str, body: str, *ctes: str) -> None:
    SQL[name] = "WITH " + ",\n".join([CATEGORY_FIX.strip(), *ctes]) + "\n" + body


def _facets(lib: Library) -> DataFrame:
    return profile.facets(lib.item_genres(), lib.item_people())


def _prefs(lib: Library) -> DataFrame:
    return profile.accumulate(lib.plays(), _facets(lib), AS_OF, lib.parts("lineitem"))


def _weights(lib: Library) -> DataFrame:
    return scoring.weights_for(lib.categories(), lib.weights())


def _inputs(lib: Library) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facets, plays and preferences as a run finds them: tables, as of its start."""
    facets, plays = lib.snapshot(_facets(lib), "facets"), lib.snapshot(lib.plays(), "plays")
    return facets, plays, lib.snapshot(profile.accumulate(plays, facets, AS_OF, lib.parts("lineitem")), "preferences")


def _catalogue(lib: Library, plays: DataFrame) -> DataFrame:
    return lib.snapshot(scoring.catalogue(lib.items(), plays), "catalogue")


def _parts(lib: Library) -> DataFrame:
    inputs = _inputs(lib)
    return scoring.with_terms(scoring.score_parts(lib.users(), lib.items(), *inputs, cat=_catalogue(lib, inputs[1])), _weights(lib))


def _top(lib: Library) -> tuple[DataFrame, DataFrame]:
    """The best of each user and category, and the catalogue they are from."""
    inputs = _inputs(lib)
    cat = _catalogue(lib, inputs[1])
    return scoring.recommend(lib.users(), lib.items(), *inputs, _weights(lib), SEED, TOP, cat=cat), cat


@_query
def recency_buckets(lib: Library) -> DataFrame:
    tenths = lambda plays, at: plays.select(S.recency_tenths(F.col("last_played"), at).alias("tenths"))
    both = tenths(lib.plays(), AS_OF).withColumn("source", F.lit("orders")).unionByName(tenths(lib.event_plays(), EVENTS_AS_OF).withColumn("source", F.lit("events")))
    return both.groupBy("source", "tenths").agg(F.count(F.lit(1)).alias("n"))


_BUCKET = "CASE WHEN last_played IS NULL THEN 7 WHEN d < 30 THEN 15 WHEN d < 90 THEN 10 WHEN d < 365 THEN 6 ELSE 3 END"
_sql(
    "recency_buckets",
    f"""SELECT source, {_BUCKET} AS tenths, count(*) AS n FROM (
SELECT 'orders' AS source, last_played, datesub('day', last_played, TIMESTAMP '{AS_OF}') AS d FROM plays
UNION ALL SELECT 'events', t, datesub('day', t, TIMESTAMP '{EVENTS_AS_OF}') FROM (SELECT max(ts) AS t FROM events GROUP BY user_id, CAST(json_extract_string(props, '$.k') AS BIGINT))) GROUP BY ALL""",
)


@_query
def facet_prefs(lib: Library) -> DataFrame:
    return _prefs(lib)


_sql("facet_prefs", "SELECT * FROM prefs")


@_query
def facet_prefs_streamed(lib: Library) -> DataFrame:
    """Profiles kept as state over plays that arrive in three parts, with older plays of the same items after newer ones."""
    spark, path = lib.spark, shared_path(lib.spark, "arriving-plays")
    facets, plays = lib.snapshot(_facets(lib), "facets"), lib.snapshot(lib.plays(), "plays").withColumn("part", F.pmod(F.xxhash64("user_id", "item_id"), F.lit(3)))
    older = plays.where("part < 2").withColumns({"last_played": F.col("last_played") - F.expr("INTERVAL 400 DAYS"), "part": F.lit(2)})
    clock = spark.range(1).select((F.col("id") - 1).alias("user_id"), F.lit(-1).cast("long").alias("item_id"), F.lit(None).cast("timestamp_ntz").alias("last_played"), F.lit(3).alias("part"))  # a tick of the time as of which profiles are wanted
    kind = "user_id long, item_id long, last_played timestamp_ntz, arrived timestamp"
    for k, when in enumerate(("1999-01-01 00:00:00", "2000-06-01 00:00:00", "2001-07-01 00:00:00", AS_OF + ".001")):
        arriving = (plays, plays, plays.unionByName(older), clock)[k].where(F.col("part") == k)
        arriving.select("user_id", "item_id", "last_played", F.to_utc_timestamp(F.lit(when), F.current_timezone()).alias("arrived")).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(kind).parquet(f"{path}/in")
        stream_profiles.keep_profiles(stream_profiles.profile_changes(stream, facets), f"{path}/out", f"{path}/state").awaitTermination()  # each time from where it was
    return stream_profiles.read_profiles(spark, f"{path}/out")


SQL["facet_prefs_streamed"] = SQL["facet_prefs"]


@_query
def prefs_normalised(lib: Library) -> DataFrame:
    return profile.normalise(_prefs(lib))


_sql("prefs_normalised", "SELECT user_id, facet, value, num, max_num, CAST(num AS DOUBLE) / CAST(max_num AS DOUBLE) AS pref FROM prefs JOIN maxima USING (user_id, facet)")


@_query
def liked_collections(lib: Library) -> DataFrame:
    return profile.user_collections(lib.plays(), lib.items())


_sql("liked_collections", "SELECT * FROM liked")


@_query
def cold_users(lib: Library) -> DataFrame:
    return profile.warmth(lib.users(), lib.plays())


_sql("cold_users", "SELECT * FROM warm")


@_query
def candidates_capped(lib: Library) -> DataFrame:
    return scoring.candidates(lib.users(), lib.items(), lib.plays())


_sql("candidates_capped", "SELECT user_id, category, item_id FROM cand", CANDIDATES)


@_query
def source_candidates(lib: Library) -> DataFrame:
    """Candidates from the categories' source libraries and of their types only."""
    items = scoring.source_items(lib.library_items(), scoring.library_mapping(lib.categories(), lib.libraries()))
    return scoring.candidates(lib.users(), items, lib.plays(), 20)


_sql(
    "source_candidates",
    """SELECT user_id, category, item_id FROM (SELECT u.user_id, s.category, s.item_id, row_number() OVER (PARTITION BY u.user_id, s.category ORDER BY s.item_id) AS n
FROM users u CROSS JOIN (SELECT i.item_id, k.category FROM items i JOIN libraries l ON l.item_id = 'lib' || (i.item_id % 25) JOIN categories k ON k.api_type = l.collection_type AND k.category = i.category) s
LEFT JOIN plays p ON u.user_id = p.user_id AND s.item_id = p.item_id WHERE p.item_id IS NULL) WHERE n <= 20""",
)


@_query
def latest_plays(lib: Library) -> DataFrame:
    """Each user's latest plays, at most 4."""
    return readers.cap_plays(lib.plays(), 4)


_sql("latest_plays", "SELECT user_id, item_id, last_played FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_played DESC NULLS LAST, item_id) AS r FROM plays) WHERE r <= 4")


@_query
def fallback_weights(lib: Library) -> DataFrame:
    """Weights where only Movies has a row: all categories have its factors."""
    own = scoring.weights_for(lib.categories(), lib.weights().where("category = 'Movies'"))
    return own.select("category", "min_score", "genres", "actors", "directors", "collection_weight").join(lib.items().groupBy("category").agg(F.count(F.lit(1)).alias("n_items")), "category")


_sql("fallback_weights", "SELECT k.category, k.min_score, m.genres, m.actors, m.directors, m.collection_weight, n_items FROM categories k CROSS JOIN (SELECT * FROM categories WHERE category = 'Movies') m JOIN (SELECT category, count(*) AS n_items FROM items GROUP BY category) i ON k.category = i.category")


@_query
def category_weights(lib: Library) -> DataFrame:
    return _weights(lib).select("category", "min_score", "genres", "actors", "directors", "collection_weight", "diversity").join(lib.items().groupBy("category").agg(F.count(F.lit(1)).alias("n_items")), "category")


_sql("category_weights", "SELECT k.category, min_score, genres, actors, directors, collection_weight, diversity, n_items FROM categories k JOIN (SELECT category, count(*) AS n_items FROM items GROUP BY category) i ON k.category = i.category")


@_query
def scores_warm(lib: Library) -> DataFrame:
    return _parts(lib).where("warm").select("user_id", "category", "item_id", scoring.score(SEED, 0).alias("score"))


_sql("scores_warm", f"SELECT user_id, category, item_id, {_SCORE(0)} AS score FROM parts WHERE warm", CANDIDATES, HITS, PARTS)


@_query
def scores_cold(lib: Library) -> DataFrame:
    return _parts(lib).where("NOT warm").select("user_id", "category", "item_id", scoring.score(SEED, 0).alias("score"))


_sql("scores_cold", f"SELECT user_id, category, item_id, {_SCORE(0)} AS score FROM parts WHERE NOT warm", CANDIDATES, HITS, PARTS)


@_query
def qualified_counts(lib: Library) -> DataFrame:
    return scoring.qualify(_parts(lib), SEED).groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("n"))


_sql("qualified_counts", f"SELECT user_id, category, count(*) AS n FROM parts WHERE path IS NOT NULL AND path <> '' AND {_SCORE(0)} >= min_score GROUP BY user_id, category", CANDIDATES, HITS, PARTS)


@_query
def top_n(lib: Library) -> DataFrame:
    return _top(lib)[0].select("user_id", "category", "position", "item_id", "score")


_sql("top_n", "SELECT user_id, category, CAST(position AS INTEGER) AS position, item_id, score FROM tops", CANDIDATES, HITS, PARTS, TOPS)


@_query
def score_parts(lib: Library) -> DataFrame:
    return _top(lib)[0].select("user_id", "category", "position", "item_id", "genre_part", "director_part", "actor_part", "collection_part", "score")


_sql("score_parts", "SELECT user_id, category, CAST(position AS INTEGER) AS position, item_id, genre_part, director_part, actor_part, collection_part, score FROM tops", CANDIDATES, HITS, PARTS, TOPS)


@_query
def top_n_exact(lib: Library) -> DataFrame:
    """The best of all unplayed items, not of the first 600."""
    facets, plays = lib.snapshot(_facets(lib), "facets"), lib.snapshot(lib.plays(), "plays")
    prefs = profile.accumulate(plays, facets, AS_OF, lib.parts("lineitem"))
    found = exact.best(lib.users(), lib.items(), facets, plays, prefs, _weights(lib), SEED, TOP, keep=lambda df: lib.snapshot(df, "tastes"))
    return found.select("user_id", "category", "position", "item_id", "score")


_sql("top_n_exact", "SELECT user_id, category, CAST(position AS INTEGER) AS position, item_id, score FROM tops", CANDIDATES.replace("WHERE n <= 600", ""), HITS, PARTS, TOPS)


@_query
def library_mapping(lib: Library) -> DataFrame:
    return scoring.library_mapping(lib.categories(), lib.libraries()).select("category", "discovery_name", "min_score", F.array_join("source_ids", ",").alias("source_ids"))


_sql("library_mapping", "SELECT category, discovery_name, min_score, string_agg(item_id, ',' ORDER BY item_id) AS source_ids FROM categories JOIN libraries ON api_type = collection_type GROUP BY ALL")


@_query
def stale_libraries(lib: Library) -> DataFrame:
    return audit.stale_libraries(lib.libraries(), scoring.library_mapping(lib.categories(), lib.libraries()))


_sql("stale_libraries", f"SELECT item_id, name FROM libraries l WHERE (contains(name, {Z}) OR contains(name, 'Discover') OR contains(name, 'Recommended')) AND NOT EXISTS (SELECT 1 FROM categories WHERE starts_with(l.name, discovery_name))")


@_query
def prune_deleted(lib: Library) -> DataFrame:
    gone = lib.libraries().where("ordinal % 5 = 2").select("item_id")
    return audit.prune_deleted(lib.users(), gone).select("user_id", F.array_join("new_folders", ",").alias("new_folders"), "removed_count")


_sql("prune_deleted", "SELECT user_id, coalesce(string_agg(f, ',' ORDER BY pos) FILTER (WHERE NOT gone), '') AS new_folders, count(*) FILTER (WHERE gone) AS removed_count FROM (SELECT *, f IN (SELECT item_id FROM libraries WHERE ordinal % 5 = 2) AS gone FROM (SELECT user_id, unnest(enabled_folders) AS f, unnest([0, 1, 2]) AS pos FROM users)) GROUP BY user_id HAVING count(*) FILTER (WHERE gone) > 0")


@_query
def prune_ghosts(lib: Library) -> DataFrame:
    return audit.prune_ghosts(lib.users(), lib.libraries()).select("user_id", F.array_join("new_folders", ",").alias("new_folders"), "removed_count")


_sql("prune_ghosts", "SELECT user_id, coalesce(string_agg(f, ',' ORDER BY pos) FILTER (WHERE NOT gone), '') AS new_folders, count(*) FILTER (WHERE gone) AS removed_count FROM (SELECT *, f NOT IN (SELECT item_id FROM libraries) AS gone FROM (SELECT user_id, unnest(enabled_folders) AS f, unnest([0, 1, 2]) AS pos FROM users)) GROUP BY user_id HAVING count(*) FILTER (WHERE gone) > 0")


@_query
def split_libraries(lib: Library) -> DataFrame:
    return audit.split_libraries(lib.libraries(), ROOT).select("item_id", "generated")


_sql("split_libraries", f"SELECT item_id, len(list_filter(locations, lambda x: contains(lower(x), '{ROOT.lower()}'))) > 0 AS generated FROM libraries WHERE len(locations) > 0")
_OWN = f"own AS (SELECT u.user_id, l.item_id, l.ordinal FROM users u JOIN libraries l ON len(list_filter(l.locations, lambda x: contains(lower(x), '{ROOT.lower()}'))) > 0 AND len(list_filter(l.locations, lambda x: contains(lower(x), '/' || lower({_SAFE('u.name')}) || '/'))) > 0)"


@_query
def user_libraries(lib: Library) -> DataFrame:
    return audit.user_libraries(lib.users(), audit.split_libraries(lib.libraries(), ROOT).where("generated"))


_sql("user_libraries", "SELECT user_id, item_id AS library_id FROM own", _OWN)


@_query
def rebuilt_policies(lib: Library) -> DataFrame:
    return audit.rebuild_policies(lib.users(), lib.libraries(), ROOT).select("user_id", "enable_all", F.array_join("enabled_folders", ",").alias("enabled_folders"), "n_real", "n_own")


_REAL = f"reals AS (SELECT string_agg(item_id, ',' ORDER BY ordinal) AS ids, count(*) AS n FROM libraries WHERE len(locations) > 0 AND len(list_filter(locations, lambda x: contains(lower(x), '{ROOT.lower()}'))) = 0)"
_sql("rebuilt_policies", "SELECT u.user_id, false AS enable_all, concat_ws(',', r.ids, o.ids) AS enabled_folders, r.n AS n_real, coalesce(o.n, 0) AS n_own FROM users u CROSS JOIN reals r LEFT JOIN (SELECT user_id, string_agg(item_id, ',' ORDER BY ordinal) AS ids, count(*) AS n FROM own GROUP BY user_id) o ON u.user_id = o.user_id", _OWN, _REAL)


@_query
def visibility_summary(lib: Library) -> DataFrame:
    return audit.visibility_summary(audit.rebuild_policies(lib.users(), lib.libraries(), ROOT))


_sql("visibility_summary", "SELECT u.user_id, r.n AS n_real, coalesce(o.n, 0) AS n_own FROM users u CROSS JOIN reals r LEFT JOIN (SELECT user_id, count(*) AS n FROM own GROUP BY user_id) o ON u.user_id = o.user_id", _OWN, _REAL)


def _policy_log(lib: Library) -> tuple[DataFrame, str]:
    """Policies before, and a written log: lists without deleted libraries, without ghosts, and rebuilt ones for every other user."""
    path, users = shared_path(lib.spark, "policy-log"), lib.users()
    gone = lib.libraries().where("ordinal % 5 = 2").select("item_id")
    state = policies.initial_state(users)
    first = policies.as_changes(audit.prune_deleted(users, gone), "deleted", 1)
    policies.append_changes(first, path)
    now = policies.apply_changes(state, policies.read_changes(lib.spark, path)).select("user_id", F.col("folders").alias("enabled_folders"))
    policies.append_changes(policies.as_changes(audit.prune_ghosts(now, lib.libraries()), "ghosts", 2), path)
    rebuilt = audit.rebuild_policies(users.where("user_id % 2 = 0"), lib.libraries(), ROOT)
    policies.append_changes(policies.as_changes(rebuilt, "rebuilt", 3, "enabled_folders"), path)
    return state, path


_shown = lambda state: state.select("user_id", F.array_join("folders", ",").alias("folders"), "seq")


@_query
def policy_state(lib: Library) -> DataFrame:
    """All changes, applied in pieces of which some come twice."""
    state, path = _policy_log(lib)
    read = lambda after, until=None: policies.read_changes(lib.spark, path, after, until)
    for piece in (read(0, 1), read(0, 2), read(1), read(0, 2), read(2)):
        state = policies.apply_changes(state, piece)
    return _shown(state)


@_query
def policy_replayed(lib: Library) -> DataFrame:
    """The state after the second change, from the log alone."""
    state, path = _policy_log(lib)
    return _shown(policies.apply_changes(state, policies.read_changes(lib.spark, path), until=2))


_POLICY_LOG = """each AS (SELECT user_id, f, pos, f IN (SELECT item_id FROM libraries WHERE ordinal % 5 = 2) AS gone, f IN (SELECT item_id FROM libraries) AS known FROM (SELECT user_id, unnest(enabled_folders) AS f, unnest([0, 1, 2]) AS pos FROM users)),
pruned AS (SELECT user_id, coalesce(string_agg(f, ',' ORDER BY pos) FILTER (WHERE NOT gone AND known), '') AS folders, CASE WHEN bool_or(NOT known) THEN 2 WHEN bool_or(gone) THEN 1 ELSE 0 END AS seq FROM each GROUP BY user_id)"""
_sql("policy_replayed", "SELECT user_id, folders, CAST(seq AS BIGINT) AS seq FROM pruned", _POLICY_LOG)
_sql("policy_state", "SELECT p.user_id, CASE WHEN p.user_id % 2 = 0 THEN concat_ws(',', r.ids, o.ids) ELSE folders END AS folders, CAST(CASE WHEN p.user_id % 2 = 0 THEN 3 ELSE seq END AS BIGINT) AS seq FROM pruned p CROSS JOIN reals r LEFT JOIN (SELECT user_id, string_agg(item_id, ',' ORDER BY ordinal) AS ids FROM own GROUP BY user_id) o ON p.user_id = o.user_id", _POLICY_LOG, _OWN, _REAL)


@_query
def garbage_libraries(lib: Library) -> DataFrame:
    return audit.garbage(lib.libraries())


_GARBAGE = "contains(name, 'Discover Movies') OR contains(name, 'Discover Shows') OR contains(name, 'Discover Music') OR contains(name, 'Recommended')"
_sql("garbage_libraries", f"SELECT item_id, name FROM libraries WHERE {_GARBAGE}")


@_query
def garbage_items(lib: Library) -> DataFrame:
    events = lib.table("events").select(F.col("event_id").alias("item_id"), F.concat(F.when(F.col("event_type") == "error", "Recommended ").otherwise("Discover "), F.col("event_type")).alias("name"))
    return audit.garbage(events)


_sql("garbage_items", f"SELECT item_id, name FROM (SELECT event_id AS item_id, CASE WHEN event_type = 'error' THEN 'Recommended ' ELSE 'Discover ' END || event_type AS name FROM events) WHERE {_GARBAGE}")


@_query
def safe_names(lib: Library) -> DataFrame:
    return lib.table("documents").select("doc_id", S.safe_name(F.col("text")).alias("safe"), S.display_name(F.col("lang"), F.col("doc_id") % 3).alias("shown"))


_sql("safe_names", f"SELECT doc_id, {_SAFE('text')} AS safe, lang || repeat({Z}, CAST(doc_id % 3 + 1 AS INTEGER)) AS shown FROM documents")


@_query
def name_collisions(lib: Library) -> DataFrame:
    return audit.name_collisions(lib.items(), "item_id")


_sql("name_collisions", f"SELECT lower({_SAFE('name')}) AS folder, count(*) AS n, min(item_id) AS first_key, max(item_id) AS last_key FROM items GROUP BY 1 HAVING count(*) > 1")


@_query
def xml_escape(lib: Library) -> DataFrame:
    return lib.table("pages").select("page_id", S.escape_xml(F.col("html")).alias("escaped"))


_sql("xml_escape", "SELECT page_id, replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped FROM pages")
RULES = [("/media/Movies", "/mnt/films"), ("/media/M", "/mnt/m")]
DRIVES = [("/m", "//nas/media")]


@_query
def path_substitution(lib: Library) -> DataFrame:
    path = F.col("path")
    replaced = S.resolve_path(path, RULES)
    return lib.items().where("path IS NOT NULL").select("item_id", replaced.alias("resolved"), S.resolve_drive(path, DRIVES, replaced).alias("on_share"))


_sql("path_substitution", "SELECT item_id, r AS resolved, CASE WHEN r <> path THEN r WHEN starts_with(upper(path), '/M') THEN '//nas/media' || substr(path, 3) ELSE path END AS on_share FROM (SELECT item_id, path, CASE WHEN starts_with(path, '/media/Movies') THEN '/mnt/films' || substr(path, 14) WHEN starts_with(path, '/media/M') THEN '/mnt/m' || substr(path, 9) ELSE path END AS r FROM items WHERE path IS NOT NULL)")


_NESTED = """nested AS (SELECT item_id, name, category, path, artist, item_id % 5 <> 0 AS is_folder FROM items
    UNION ALL SELECT item_id + 1000000, name || ' Extras', category, path || '/Extras', artist, true FROM items WHERE item_id % 6 = 1 AND item_id % 5 <> 0
    UNION ALL SELECT item_id + 2000000, name || ' Bonus', category, path || '/Extras/bonus.mkv', artist, false FROM items WHERE item_id % 12 = 1 AND item_id % 5 <> 0),
paths AS (SELECT path || '/' || unnest(['a.mkv', 'a.mp4', 'cover.jpg', 'notes.txt', 'song.flac', 'Extras/b.mkv', 'Extras/bonus.mkv', 'Extras/deep/c.flac']) AS path FROM items WHERE item_id % 5 <> 0 AND path IS NOT NULL
    UNION ALL SELECT path FROM items WHERE item_id % 5 = 0 AND path IS NOT NULL UNION ALL SELECT '/media/Loose/' || item_id || '.mkv' FROM items WHERE item_id % 11 = 0),
above AS (SELECT f.path, n.item_id, n.path AS root, max(length(n.path)) OVER (PARTITION BY f.path) AS deepest FROM paths f JOIN nested n ON f.path = n.path OR starts_with(f.path, n.path || '/')),
under AS (SELECT item_id, CASE WHEN path = root THEN '' ELSE substr(regexp_replace(path, '/[^/]*$', ''), length(root) + 2) END AS rel_path, split_part(path, '/', -1) AS file_name, split_part(path, '.', -1) AS ext, length(root) = deepest AS is_deepest FROM above)"""


def _many_rules(lib: Library) -> DataFrame:
    """A rule for each item with a path, of prefixes that nest, repeat and differ in length, in no order."""
    key = F.col("item_id")
    return lib.items().where("path IS NOT NULL").select((key * 7919 % 100_003).alias("ordinal"), F.substring("path", F.lit(1), (12 + key % 25).cast("int")).alias("prefix"), F.concat(F.lit("/r"), key.cast("string"), F.lit(":")).alias("replacement"))


@_query
def paths_by_rules(lib: Library) -> DataFrame:
    """Thousands of rules; each path is looked up once. More than fit into settings meet the paths in a join."""
    first = S.first_rules(_many_rules(lib))
    rules = [tuple(r) for r in first.limit(S.MOST_SHARED + 1).collect()]
    if len(rules) > S.MOST_SHARED:
        return paths_by_rule_table(lib)
    return lib.paths().select("path", S.resolve_by_rules(F.col("path"), rules).alias("resolved"))


_sql(
    "paths_by_rules",
    """SELECT path, coalesce(arg_min(replacement || substr(path, length(prefix) + 1), ordinal), path) AS resolved
FROM paths LEFT JOIN (SELECT item_id * 7919 % 100003 AS ordinal, substr(path, 1, CAST(12 + item_id % 25 AS INTEGER)) AS prefix, '/r' || item_id || ':' AS replacement FROM items WHERE path IS NOT NULL) r ON starts_with(paths.path, r.prefix) GROUP BY path""",
    _NESTED,
)


@_query
def paths_by_rule_table(lib: Library) -> DataFrame:
    """The same by a join, for any number of rules."""
    paths = lib.paths().withColumn("item_id", F.col("path"))
    return S.resolve_by_table(paths, _many_rules(lib)).select("path", "resolved")


SQL["paths_by_rule_table"] = SQL["paths_by_rules"]


@_query
def file_classes(lib: Library) -> DataFrame:
    rows = lib.files().join(lib.items().select("item_id", "category"), "item_id").withColumn("action", S.file_action(F.col("ext"), F.col("category") == "Music"))
    return rows.where("action IS NOT NULL").groupBy("category", "ext", "action").agg(F.count(F.lit(1)).alias("n"))


_FILES = "files AS (SELECT item_id, unnest(['a.mkv', 'a.mp4', 'cover.jpg', 'song.flac']) AS file_name, unnest(['mkv', 'mp4', 'jpg', 'flac']) AS ext FROM items)"
_ACTION = "CASE WHEN ext = 'jpg' THEN 'copy' WHEN category = 'Music' THEN 'link' ELSE 'strm' END"
_sql("file_classes", f"SELECT category, ext, {_ACTION} AS action, count(*) AS n FROM files JOIN items USING (item_id) GROUP BY ALL", _FILES)


@_query
def artists(lib: Library) -> DataFrame:
    return lib.items().select("item_id", S.artist(F.col("album_artist"), F.col("artists")).alias("artist"))


_sql("artists", "SELECT item_id, artist FROM items")


def _published(lib: Library) -> tuple[DataFrame, DataFrame]:
    """The lists with their users' names, and the catalogue they are from."""
    top, cat = _top(lib)
    return top.join(lib.users().select("user_id", F.col("name").alias("user_name")).hint("merge"), "user_id"), cat


def _manifest(lib: Library, path: Column | None = None) -> DataFrame:
    lists, cat = _published(lib)
    return manifest.lists_manifest(lists, scoring.bounded(manifest.item_links(cat, lib.files(), path))[0])


@_query
def link_manifest(lib: Library) -> DataFrame:
    return _manifest(lib)


_FOLDER = f"folders AS (SELECT t.*, {_SAFE('u.name')} || '/' || category || '/' || CASE WHEN category = 'Music' THEN {_SAFE('t.artist')} || '/' ELSE '' END || {_SAFE('t.name')} AS root, t.item_id % 5 <> 0 AS is_folder FROM tops t JOIN users u ON t.user_id = u.user_id)"
_sql(
    "link_manifest",
    f"""SELECT user_id, category, target, action, CASE WHEN action = 'copy' THEN min(source) ELSE max(source) END AS source, count(*) AS n_sources FROM (
SELECT user_id, category, root || '/' || CASE WHEN {_ACTION} = 'strm' THEN regexp_replace(file_name, '\\.[^.]*$', '') || '.strm' ELSE file_name END AS target, path || '/' || file_name AS source, {_ACTION} AS action FROM folders JOIN files USING (item_id) WHERE is_folder
UNION ALL SELECT user_id, category, root || '/' || split_part(path, '/', -1) || '.strm', path, 'strm' FROM folders WHERE NOT is_folder) GROUP BY user_id, category, target, action""",
    CANDIDATES, HITS, PARTS, TOPS, _FOLDER, _FILES,
)


@_query
def link_manifest_on_share(lib: Library) -> DataFrame:
    """The manifest with substituted paths."""
    path = F.col("path")
    return _manifest(lib, S.resolve_drive(path, DRIVES, S.resolve_path(path, RULES)))


_SHARE = "CASE WHEN starts_with(path, '/media/Movies') THEN '/mnt/films' || substr(path, 14) WHEN starts_with(path, '/media/M') THEN '/mnt/m' || substr(path, 9) WHEN starts_with(upper(path), '/M') THEN '//nas/media' || substr(path, 3) ELSE path END"
SQL["link_manifest_on_share"] = SQL["link_manifest"].replace("SELECT t.*, ", f"SELECT t.* EXCLUDE (path), {_SHARE.replace('path', 't.path')} AS path, ")


@_query
def sidecar_docs(lib: Library) -> DataFrame:
    lists, cat = _published(lib)
    return manifest.lists_docs(lists, scoring.bounded(manifest.item_docs(cat))[0])


_XML = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_sql(
    "sidecar_docs",
    f"""SELECT target, doc FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY user_id, position) AS r FROM (
SELECT root || '/album.nfo' AS target, '<album><title>' || {_XML(_SAFE('name'))} || '</title><artist>' || {_XML(_SAFE('artist'))} || '</artist></album>' AS doc, user_id, position FROM folders WHERE category = 'Music'
UNION ALL SELECT regexp_replace(root, '/[^/]*$', '') || '/artist.nfo', '<artist><name>' || {_XML(_SAFE('artist'))} || '</name></artist>', user_id, position FROM folders WHERE category = 'Music')) WHERE r = 1""",
    CANDIDATES, HITS, PARTS, TOPS, _FOLDER,
)
@_query
def files_under_items(lib: Library) -> DataFrame:
    """Each file of the inventory with the deepest item that holds it."""
    return folders.files_under_items(lib.paths(), lib.nested_items())


_sql("files_under_items", "SELECT item_id, rel_path, file_name, ext FROM under WHERE is_deepest", _NESTED)


@_query
def files_walked(lib: Library) -> DataFrame:
    """Each file with every item above it."""
    return folders.files_under_items(lib.paths(), lib.nested_items(), deepest=False)


_sql("files_walked", "SELECT item_id, rel_path, file_name, ext FROM under", _NESTED)


@_query
def manifest_from_paths(lib: Library) -> DataFrame:
    """From raw paths to the link manifest, nested items included."""
    lists = lib.play_lists(lib.nested_items()).join(lib.users().select("user_id", F.col("name").alias("user_name")).hint("merge"), "user_id")
    return manifest.link_manifest(lists, folders.files_under_items(lib.paths(), lib.nested_items()))


_KIND = "CASE WHEN ext IN ('jpg') THEN 'copy' WHEN ext = 'txt' THEN NULL WHEN category = 'Music' THEN 'link' ELSE 'strm' END"
_ROOT = lambda folder, t: f"{folder} || '/' || {t}.category || '/' || CASE WHEN {t}.category = 'Music' THEN {_SAFE(f'{t}.artist')} || '/' ELSE '' END || {_SAFE(f'{t}.name')}"
_sql(
    "manifest_from_paths",
    f"""SELECT user_id, category, target, action, CASE WHEN action = 'copy' THEN min(source) ELSE max(source) END AS source, count(*) AS n_sources FROM (
SELECT user_id, category, concat_ws('/', root, nullif(rel_path, ''), CASE WHEN {_KIND} = 'strm' THEN regexp_replace(file_name, '\\.[^.]*$', '') || '.strm' ELSE file_name END) AS target, concat_ws('/', path, nullif(rel_path, ''), file_name) AS source, {_KIND} AS action
FROM listed JOIN under USING (item_id) WHERE is_folder AND is_deepest AND {_KIND} IS NOT NULL
UNION ALL SELECT user_id, category, root || '/' || split_part(path, '/', -1) || '.strm', path, 'strm' FROM listed WHERE NOT is_folder) GROUP BY user_id, category, target, action""",
    _NESTED, f"listed AS (SELECT p.user_id, n.*, {_ROOT(_SAFE('u.name'), 'n')} AS root FROM plays p JOIN nested n ON n.item_id % 1000000 = p.item_id JOIN users u ON u.user_id = p.user_id WHERE n.path IS NOT NULL)",
)
SINCE = "2000-01-01"


def _folder_runs(lib: Library) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The targets of an earlier run over older plays, the owners of a later run that serves two thirds of the users, and its targets."""
    older = lib.plays().where(F.col("last_played") < F.lit(SINCE).cast("timestamp_ntz"))
    before, now = lib.play_lists(plays=older), lib.play_lists().where("user_id % 3 <> 0")
    empty_handed = lib.users().where("user_id % 7 = 0").select("user_id", F.lit("Music").alias("category"))  # served, with an empty list or not
    served = now.select("user_id", "category").unionByName(empty_handed.where("user_id % 3 <> 0"))
    owners = folders.folder_owners(lib.housemates(), served)
    old = folders.owned_targets(before, folders.folder_owners(lib.housemates(), before), lib.files())
    return old, owners, folders.owned_targets(now, owners, lib.files())


@_query
def owned_targets(lib: Library) -> DataFrame:
    """One row a target over all users, where users with one safe name share a folder."""
    return _folder_runs(lib)[2]


def _targets_sql(lists: str, served: str, name: str) -> str:
    """CTEs that end with `name`: the owned targets of lists."""
    return f"""{name}_owners AS (SELECT folder, category, user_id FROM (SELECT *, row_number() OVER (PARTITION BY folder, category ORDER BY ordinal DESC, user_id DESC) AS r FROM (SELECT s.user_id, s.category, h.ordinal, {_SAFE('h.name')} AS folder FROM {served} s JOIN house h ON s.user_id = h.user_id)) WHERE r = 1),
{name}_listed AS (SELECT l.*, o.folder, {_ROOT('o.folder', 'l')} AS root FROM {lists} l JOIN {name}_owners o ON l.user_id = o.user_id AND l.category = o.category),
{name}_docs AS (SELECT folder, category, target, arg_min(doc, position) AS doc FROM (
    SELECT folder, category, root || '/album.nfo' AS target, '<album><title>' || {_XML(_SAFE('name'))} || '</title><artist>' || {_XML(_SAFE('artist'))} || '</artist></album>' AS doc, position FROM {name}_listed WHERE category = 'Music'
    UNION ALL SELECT folder, category, regexp_replace(root, '/[^/]*$', '') || '/artist.nfo', '<artist><name>' || {_XML(_SAFE('artist'))} || '</name></artist>', position FROM {name}_listed WHERE category = 'Music') GROUP BY ALL),
{name}_files AS (SELECT folder, category, position, target, action, CASE WHEN action = 'copy' THEN min(source) ELSE max(source) END AS source FROM (
    SELECT folder, category, position, root || '/' || CASE WHEN {_ACTION} = 'strm' THEN regexp_replace(file_name, '\\.[^.]*$', '') || '.strm' ELSE file_name END AS target, path || '/' || file_name AS source, {_ACTION} AS action FROM {name}_listed JOIN files USING (item_id) WHERE is_folder
    UNION ALL SELECT folder, category, position, root || '/' || split_part(path, '/', -1) || '.strm', path, 'strm' FROM {name}_listed WHERE NOT is_folder) GROUP BY folder, category, position, target, action),
{name} AS (SELECT folder, category, target, action, CASE WHEN action = 'copy' THEN arg_min(source, position) ELSE arg_max(source, position) END AS source, CAST(NULL AS VARCHAR) AS doc FROM {name}_files GROUP BY folder, category, target, action
    UNION ALL SELECT folder, category, target, 'write', NULL, doc FROM {name}_docs)"""


_LISTS = lambda name, where: f"{name} AS (SELECT p.user_id, i.category, i.item_id, i.name, i.path, i.artist, i.item_id % 5 <> 0 AS is_folder, row_number() OVER (PARTITION BY p.user_id, i.category ORDER BY i.item_id) AS position FROM plays p JOIN items i ON p.item_id = i.item_id WHERE i.path IS NOT NULL AND {where})"
_RUNS = (
    _FILES, "house AS (SELECT user_id, 'House: ' || (user_id % 400) AS name, ordinal FROM users)", _LISTS("before", f"p.last_played < TIMESTAMP '{SINCE}'"), _LISTS("now", "p.user_id % 3 <> 0"),
    "served_before AS (SELECT DISTINCT user_id, category FROM before)", "served_now AS (SELECT user_id, category FROM now UNION SELECT user_id, 'Music' FROM users WHERE user_id % 7 = 0 AND user_id % 3 <> 0)",
    _targets_sql("before", "served_before", "old"), _targets_sql("now", "served_now", "new"),
)
_sql("owned_targets", "SELECT * FROM new", *_RUNS)


@_query
def published_lists(lib: Library) -> DataFrame:
    """What readers see after two runs, of which the later served two thirds of the users, some with an empty list."""
    older = lib.plays().where(F.col("last_played") < F.lit(SINCE).cast("timestamp_ntz"))
    columns = ["user_id", "category", "position", "item_id"]
    before, now = lib.play_lists(plays=older).select(columns), lib.play_lists().where("user_id % 3 <> 0").select(columns)
    empty_handed = lib.users().where("user_id % 7 = 0 AND user_id % 3 <> 0").select("user_id", F.lit("Music").alias("category"))
    path = shared_path(lib.spark, "lists")
    sinks.publish_buckets(before, before, path, "1")
    sinks.publish_buckets(now, now.select("user_id", "category").unionByName(empty_handed), path, "2")
    return sinks.read_buckets(lib.spark, path, "user_id long, category string, position int, item_id long")


_sql("published_lists", "SELECT user_id, category, CAST(position AS INTEGER) AS position, item_id FROM now UNION ALL SELECT user_id, category, CAST(position AS INTEGER), item_id FROM before b WHERE NOT EXISTS (SELECT 1 FROM served_now s WHERE s.user_id = b.user_id AND s.category = b.category)", *_RUNS)


@_query
def saved_preferences(lib: Library) -> DataFrame:
    """The preference snapshot of a day, as read back."""
    path = shared_path(lib.spark, "preferences")
    sinks.save_preferences(_prefs(lib), path, AS_OF[:10])
    return sinks.read_preferences(lib.spark, path)


_sql("saved_preferences", f"SELECT user_id, facet, value, num, '{AS_OF[:10]}' AS run_date FROM prefs")


@_query
def target_changes(lib: Library) -> DataFrame:
    """What the later run creates, replaces and deletes."""
    old, owners, new = _folder_runs(lib)
    return folders.target_changes(new, old, owners)


_sql(
    "target_changes",
    """SELECT change, folder, category, target, action, source, doc FROM (
SELECT CASE WHEN o.target IS NULL THEN 'create' WHEN n.target IS NULL THEN 'delete' WHEN (n.action, n.source, n.doc) IS DISTINCT FROM (o.action, o.source, o.doc) THEN 'replace' END AS change,
    coalesce(n.folder, o.folder) AS folder, coalesce(n.category, o.category) AS category, coalesce(n.target, o.target) AS target, CASE WHEN n.target IS NULL THEN o.action ELSE n.action END AS action, CASE WHEN n.target IS NULL THEN o.source ELSE n.source END AS source, CASE WHEN n.target IS NULL THEN o.doc ELSE n.doc END AS doc
FROM new n FULL JOIN (SELECT old.* FROM old JOIN new_owners w ON old.folder = w.folder AND old.category = w.category) o ON n.target = o.target) WHERE change IS NOT NULL""",
    *_RUNS,
)


@_query
def target_state(lib: Library) -> DataFrame:
    """All targets after the later run: folders that it didn't write keep theirs."""
    old, owners, new = _folder_runs(lib)
    return folders.with_changes(old, folders.target_changes(new, old, owners))


_sql("target_state", "SELECT * FROM new UNION ALL SELECT old.* FROM old WHERE NOT EXISTS (SELECT 1 FROM new_owners w WHERE old.folder = w.folder AND old.category = w.category)", *_RUNS)
_LOG = "log AS (SELECT 'log' || (user_id % 10) AS file, event_id AS line_no, 'run [' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || '] ' || event_type || ' ' || CAST(floor(value) AS BIGINT) AS line FROM events)"
_ERRORS = "(contains(line, 'ERROR') OR contains(line, 'CRITICAL') OR contains(line, 'Traceback'))"


@_query
def log_digest(lib: Library) -> DataFrame:
    return logs.error_digest(lib.log_lines())


_sql("log_digest", f"SELECT file, CAST(position AS INTEGER) AS position, message, first_line FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY first_line) AS position FROM (SELECT file, trim(split_part(line, 'ERROR', -1)) AS message, min(line_no) AS first_line FROM log WHERE {_ERRORS} GROUP BY 1, 2)) WHERE position <= 3", _LOG)


@_query
def log_status(lib: Library) -> DataFrame:
    return logs.run_status(lib.log_lines())


_sql("log_status", f"SELECT file, count(*) FILTER (WHERE {_ERRORS}) = 0 AS success, count(*) FILTER (WHERE {_ERRORS}) AS n_errors FROM log GROUP BY file", _LOG)


@_query
def log_tail(lib: Library) -> DataFrame:
    return logs.log_tail(lib.log_lines()).select("file", "line_no", "line")


_sql("log_tail", "SELECT file, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no DESC) AS r FROM log) WHERE r <= 100", _LOG)


@_query
def log_tail_latest(lib: Library) -> DataFrame:
    """The last 100 lines of the log modified last."""
    return logs.log_tail(logs.latest_file(lib.log_lines())).select("file", "line_no", "line")


_sql("log_tail_latest", "SELECT file, line_no, line FROM (SELECT *, row_number() OVER (ORDER BY line_no DESC) AS r FROM log WHERE file = (SELECT 'log' || (user_id % 10) FROM events ORDER BY ts DESC, 'log' || (user_id % 10) DESC LIMIT 1)) WHERE r <= 100", _LOG)


def _written_logs(lib: Library) -> str:
    """The events' lines as text files, a folder for each log."""
    path = shared_path(lib.spark, "logs")
    lines = lib.log_lines().select("file", "line_no", "line")
    ordered = lines.repartition("file").sortWithinPartitions("file", "line_no")
    ordered.select("file", F.col("line").alias("value")).write.partitionBy("file").text(path)
    return path


@_query
def log_lines_split(lib: Library) -> DataFrame:
    """The lines of written log files, numbered in each file by splits of 8 KB."""
    path, setting = _written_logs(lib), "spark.sql.files.maxPartitionBytes"
    whole = lib.spark.conf.get(setting)
    lib.spark.conf.set(setting, "8k")
    try:  # splits are planned here
        found = log_files.split_lines(lib.spark, path, "*.txt", F.col("file")).select("file", "line_no", "line")
        kept = shared_path(lib.spark, "log-lines")
        found.write.parquet(kept)
    finally:
        lib.spark.conf.set(setting, whole)
    return lib.spark.read.schema(found.schema).parquet(kept)


_sql("log_lines_split", "SELECT file, row_number() OVER (PARTITION BY file ORDER BY line_no) - 1 AS line_no, line FROM log", _LOG)


@_query
def log_errors_streamed(lib: Library) -> DataFrame:
    """Error lines of the event files, taken as a stream over what is there, as the stream wrote them."""
    scratch = shared_path(lib.spark, "log-errors")
    stream = Library(lib.spark, lib.sf_dir, stream=True)
    stream_logs.write_errors(stream_logs.errors(stream.log_lines()), f"{scratch}/out", f"{scratch}/state").awaitTermination()
    return lib.spark.read.schema("file string, level string, message string, clean_message string").parquet(f"{scratch}/out")


@_query
def log_errors(lib: Library) -> DataFrame:
    """What the stream gives for the same lines."""
    return stream_logs.errors(lib.log_lines())


_sql("log_errors", f"SELECT file, nullif(regexp_extract(line, '\\[([A-Z]+)\\]', 1), '') AS level, trim(split_part(line, 'ERROR', -1)) AS message, trim(regexp_replace(trim(split_part(line, 'ERROR', -1)), '^\\]', '')) AS clean_message FROM log WHERE {_ERRORS}", _LOG)
SQL["log_errors_streamed"] = SQL["log_errors"]
