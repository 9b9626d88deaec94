"""Output manifests: what files a published list needs, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import artist, escape_xml, file_action, safe_name


def user_folder() -> F.Column:
    return safe_name(F.coalesce(F.nullif("user_name", F.lit("")), F.col("user_id").cast("string")))


def item_folder() -> F.Column:
    """category/[artist/]name for an item."""
    music = F.col("category") == "Music"
    return F.concat_ws("/", F.col("category"), F.when(music, safe_name(artist(F.col("album_artist"), F.col("artists")))), safe_name(F.col("name")))


def target_folder() -> F.Column:
    """user/category/[artist/]name for a recommended item."""
    return F.concat_ws("/", user_folder(), item_folder())


def link_manifest(top: DataFrame, files: DataFrame, path: F.Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Rows (user_id, category, target, source, action, n_sources): one for each file to be made.

    `top` has user_id, user_name, category, item columns and is_folder; `files` has item_id,
    rel_path, file_name and ext, where rel_path is the folder below the item. Of several sources
    for one target the last wins, or for copies the first, by source; n_sources reports it.
    `path` resolves an item's path. Columns `by` of the list are kept apart, so that one list's
    rows stay in its order.
    """
    by = by or []
    rows = _made(top.withColumn("root", target_folder()), files, path)
    each = rows.select("user_id", "category", *by, "target", "source", "action")
    first = F.min(F.when(F.col("action") == "copy", F.col("source")))
    return each.groupBy("user_id", "category", *by, "target", "action").agg(F.coalesce(first, F.max("source")).alias("source"), F.count(F.lit(1)).alias("n_sources"))


def _made(rows: DataFrame, files: DataFrame, path: F.Column | None = None) -> DataFrame:
    """The rows with target, source and action of each file to be made below `root`."""
    rows = rows.withColumn("real_path", F.col("path") if path is None else path)
    # one pass over the list: items that are files match none of `files`
    found = files.select(F.col("item_id").alias("of_item"), "rel_path", "file_name", "ext").hint("merge")  # it grows with the library
    every = rows.where("is_folder IS NOT NULL").join(found, (F.col("item_id") == F.col("of_item")) & F.col("is_folder"), "left")
    each = every.withColumn("action", F.when(F.col("is_folder"), file_action(F.col("ext"), F.col("category") == "Music")).otherwise("strm")).where("action IS NOT NULL")
    stem = F.regexp_replace("file_name", r"(?<=.)\.[^.]*$", "")
    made = F.when(F.col("action") == "strm", F.concat(stem, F.lit(".strm"))).otherwise(F.col("file_name"))
    below = F.nullif("rel_path", F.lit(""))
    alone = F.concat_ws("/", "root", F.concat(F.element_at(F.split("real_path", r"[/\\]"), -1), F.lit(".strm")))
    target = F.when(F.col("is_folder"), F.concat_ws("/", "root", below, made)).otherwise(alone)
    source = F.when(F.col("is_folder"), F.concat_ws("/", "real_path", below, F.col("file_name"))).otherwise(F.col("real_path"))
    return each.withColumns({"target": target, "source": source})


def item_links(items: DataFrame, files: DataFrame, path: F.Column | None = None) -> DataFrame:
    """Rows (item_id, tail, action, least, greatest, n): what a list that holds the item needs, below its user's folder."""
    each = _made(items.withColumn("root", item_folder()), files, path)
    sources = F.min("source").alias("least"), F.max("source").alias("greatest"), F.count(F.lit(1)).alias("n")
    return each.groupBy("item_id", F.col("target").alias("tail"), "action").agg(*sources)


def lists_manifest(lists: DataFrame, links: DataFrame) -> DataFrame:
    """link_manifest of lists (user_id, user_name, category, item_id) whose items are few: names and paths are made once an item.

    `links` is item_links of their items. If it is broadcast, rows stay where their user is.
    """
    each = lists.select("user_id", "category", "item_id", user_folder().alias("user_folder")).join(links, "item_id")
    sums = each.groupBy("user_id", "category", "user_folder", "tail", "action").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("n").alias("n_sources"))
    source = F.when(F.col("action") == "copy", F.col("least")).otherwise(F.col("greatest")).alias("source")
    return sums.select("user_id", "category", F.concat_ws("/", "user_folder", "tail").alias("target"), "action", source, "n_sources")


def sidecar_docs(top: DataFrame) -> DataFrame:
    """Rows (target, doc): album and artist documents of music; the first in rank writes, others don't."""
    each = _documents(top.where("category = 'Music'"), target_folder())
    return each.groupBy("target").agg(F.min_by("doc", F.struct("user_id", "position")).alias("doc"))


def _documents(music: DataFrame, folder: F.Column) -> DataFrame:
    """Rows (user_id, position, target, doc)."""
    music = music.withColumn("folder", folder)
    who, what = escape_xml(safe_name(artist(F.col("album_artist"), F.col("artists")))), escape_xml(safe_name(F.col("name")))
    parent = F.regexp_replace("folder", r"/[^/]*$", "")
    album = F.struct(F.concat("folder", F.lit("/album.nfo")).alias("target"), F.concat(F.lit("<album><title>"), what, F.lit("</title><artist>"), who, F.lit("</artist></album>")).alias("doc"))
    person = F.struct(F.concat(parent, F.lit("/artist.nfo")).alias("target"), F.concat(F.lit("<artist><name>"), who, F.lit("</name></artist>")).alias("doc"))
    return music.select("user_id", "position", F.explode(F.array(album, person)).alias("made")).select("user_id", "position", "made.*")


def item_docs(items: DataFrame) -> DataFrame:
    """Rows (item_id, tail, doc): the documents of an item of music, below a user's folder."""
    alone = items.where("category = 'Music'").withColumns({"user_id": F.col("item_id"), "position": F.lit(0)})
    return _documents(alone, item_folder()).select(F.col("user_id").alias("item_id"), F.col("target").alias("tail"), "doc")


def lists_docs(lists: DataFrame, docs: DataFrame) -> DataFrame:
    """sidecar_docs of lists (user_id, user_name, category, item_id, position) whose items are few; `docs` is item_docs of their items.

    A user's own first ones are found before those of users with one folder meet.
    """
    each = lists.select("user_id", "item_id", "position", user_folder().alias("user_folder")).join(docs, "item_id")
    own = each.groupBy("user_id", "user_folder", "tail").agg(F.min_by("doc", "position").alias("doc"))
    firsts = own.groupBy("user_folder", "tail").agg(F.min_by("doc", "user_id").alias("doc"))
    return firsts.select(F.concat_ws("/", "user_folder", "tail").alias("target"), "doc")


def outputs(top: DataFrame, files: DataFrame, path: F.Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The link manifest and the documents of a run; where both would make one target, the document is made."""
    docs = sidecar_docs(top)
    return link_manifest(top, files, path).join(docs.select("target").hint("merge"), "target", "left_anti"), docs
