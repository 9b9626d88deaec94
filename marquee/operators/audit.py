"""Audits of libraries and policies: change feeds, never changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ZERO_WIDTH, safe_name

# Names by which generated libraries are known.
STALE_MARKS = (ZERO_WIDTH, "Discover", "Recommended")
GARBAGE_MARKS = ("Discover Movies", "Discover Shows", "Discover Music", "Recommended")


def _has_any(column: str, marks: tuple[str, ...]):
    found = F.lit(False)
    for mark in marks:
        found = found | F.contains(F.coalesce(column, F.lit("")), F.lit(mark))
    return found


def stale_libraries(libraries: DataFrame, mapping: DataFrame) -> DataFrame:
    """Generated libraries (item_id, name) that start with none of the names now configured."""
    marked = libraries.where(_has_any("name", STALE_MARKS)).select("item_id", "name")
    expected = F.broadcast(mapping.select("discovery_name").distinct())  # one row a category
    return marked.join(expected, F.startswith("name", "discovery_name"), "left_anti")


def garbage(rows: DataFrame) -> DataFrame:
    """Libraries or view items (item_id, name) whose name holds a generated library's."""
    return rows.where(_has_any("name", GARBAGE_MARKS)).select("item_id", "name")


def _pruned(users: DataFrame, ids: DataFrame, keep: bool) -> DataFrame:
    """Users whose list gets shorter, with the list in its old order and the number removed.

    Ids meet the lists in a join, not as an array, so that neither side needs a bound.
    """
    each = users.select("user_id", F.posexplode("enabled_folders").alias("pos", "item_id"))
    known = ids.select("item_id", F.lit(True).alias("known")).where("item_id IS NOT NULL").distinct()
    marked = each.join(known, "item_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    stays = F.col("known") if keep else ~F.col("known")
    lists = marked.groupBy("user_id").agg(F.sort_array(F.collect_list(F.when(stays, F.struct("pos", "item_id")))).alias("kept"), F.sum((~stays).cast("long")).alias("removed_count"))
    return lists.where("removed_count > 0").select("user_id", F.transform("kept", lambda x: x["item_id"]).alias("new_folders"), "removed_count")


def prune_deleted(users: DataFrame, deleted: DataFrame) -> DataFrame:
    """Policies without deleted ids (item_id); order and repeats stay, and only changed users are given."""
    return _pruned(users, deleted, keep=False)


def prune_ghosts(users: DataFrame, libraries: DataFrame) -> DataFrame:
    """Policies with existing libraries only. An empty set of libraries is an error, as it would empty all."""
    if not libraries.head(1):
        raise ValueError("no libraries: pruning would empty every policy")
    return _pruned(users, libraries, keep=True)


def split_libraries(libraries: DataFrame, root: str) -> DataFrame:
    """Libraries with locations, and whether any lies below the root of generated ones, whatever the case."""
    below = F.exists("locations", lambda x: F.contains(F.lower(x), F.lit(root.lower())))
    return libraries.where(F.size("locations") > 0).withColumn("generated", below)


def user_libraries(users: DataFrame, generated: DataFrame) -> DataFrame:
    """Rows (user_id, library_id): generated libraries with the user's folder in a location's path.

    The folder is one path segment but not the last, so this is an equi-join on segments.
    """
    folder = F.lower(safe_name(F.coalesce(F.nullif("name", F.lit("")), F.col("user_id").cast("string"))))
    segments = generated.select(F.col("item_id").alias("library_id"), F.explode("locations").alias("location")).select("library_id", F.split(F.lower("location"), r"[/\\]").alias("s"))
    segments = segments.select("library_id", F.explode(F.slice("s", F.lit(2), F.greatest(F.size("s") - 2, F.lit(0)))).alias("segment")).where("segment <> ''").distinct()
    return users.select("user_id", folder.alias("segment")).join(segments, "segment").select("user_id", "library_id").distinct()


def rebuild_policies(users: DataFrame, libraries: DataFrame, root: str) -> DataFrame:
    """Each user's new policy: all real libraries, then the user's own generated ones, in their order.

    Libraries need a column `ordinal`. The real ids are one row for all users.
    """
    split = split_libraries(libraries, root)
    ids = lambda df: F.transform(F.sort_array(F.collect_list(F.struct("ordinal", df))), lambda x: x["id"])
    real = split.where("NOT generated").agg(ids(F.col("item_id").alias("id")).alias("real"))
    own = user_libraries(users, split.where("generated")).join(split.select(F.col("item_id").alias("library_id"), "ordinal"), "library_id").groupBy("user_id").agg(ids(F.col("library_id").alias("id")).alias("own"))
    joined = users.join(own, "user_id", "left").crossJoin(F.broadcast(real))
    folders = F.concat("real", F.coalesce("own", F.array().cast("array<string>")))
    return joined.select("user_id", F.lit(False).alias("enable_all"), folders.alias("enabled_folders"), F.size("real").cast("long").alias("n_real"), F.coalesce(F.size("own"), F.lit(0)).cast("long").alias("n_own"))


def visibility_summary(policies: DataFrame) -> DataFrame:
    return policies.select("user_id", "n_real", "n_own")


def name_collisions(rows: DataFrame, key: str, name: str = "name") -> DataFrame:
    """Safe names that several rows fold to: (folder, n, first_key, last_key)."""
    folder = F.lower(safe_name(F.col(name)))
    return rows.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key")).where("n > 1")
