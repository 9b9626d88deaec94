"""Files under items, owners of output folders, and what a run changes in them.

Paths meet by their ancestors: a folder's prefixes are exploded once for each folder, not for
each file, and meet item paths in an equi-join. Both sides grow with the library and are
hinted to meet by a shuffle: by the size of their files Spark would take them as small enough
to broadcast, and the driver would build a table of all paths. Users whose safe names are equal share a folder;
the last one served owns it whole, and a run emits only the targets that differ from the state
before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_name
from .manifest import link_manifest, sidecar_docs

STATE = "folder string, category string, target string, action string, source string, doc string"


def plain_path(path: Column) -> Column:
    """A path with / between its parts, without the scheme of a local file and without / at its end."""
    local = F.regexp_replace(path, r"^file:/+", "/")
    return F.regexp_replace(F.regexp_replace(local, r"[/\\]+", "/"), r"(?<=.)/$", "")


def _prefixes(folder: Column) -> Column:
    """The folder and all folders above it."""
    parts = F.split(folder, "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.filter(every, lambda x: x != "")


def files_under_items(files: DataFrame, items: DataFrame, deepest: bool = True) -> DataFrame:
    """Rows (item_id, rel_path, file_name, ext): each file with the items whose path holds it.

    `files` has path, file_name and ext, `items` item_id and path. A file belongs to the deepest
    item above it, itself included if it is one; with deepest=False to every item above it, as walks of
    all items' folders would find it. Items of one path all have its files. rel_path is the
    folder below the item, empty for files in the item's own. Files below no item, and rows
    without a path, drop out.
    """
    placed = files.where("path IS NOT NULL").select(plain_path(F.col("path")).alias("path"), "file_name", "ext")
    placed = placed.withColumn("folder", F.regexp_replace("path", r"/[^/]*$", ""))
    roots = items.where("path IS NOT NULL AND path <> ''").select("item_id", plain_path(F.col("path")).alias("root"))
    roots = roots.hint("merge")
    own = placed.join(roots, F.col("path") == F.col("root")).select("item_id", F.lit("").alias("rel_path"), "file_name", "ext")
    rest = placed.join(roots, F.col("path") == F.col("root"), "left_anti") if deepest else placed
    above = rest.select("folder").distinct().select("folder", F.explode(_prefixes(F.col("folder"))).alias("root")).join(roots, "root")
    if deepest:
        depth = F.max(F.length("root")).over(Window.partitionBy("folder"))  # a folder's few ancestors
        above = above.withColumn("depth", depth).where(F.length("root") == F.col("depth"))
    rel = F.substring(F.col("folder"), F.length("root") + 2, F.length("folder"))
    below = rest.join(above.select("folder", "item_id", rel.alias("rel_path")).hint("merge"), "folder").select("item_id", "rel_path", "file_name", "ext")
    return below.unionByName(own)


def user_folder(users: DataFrame) -> DataFrame:
    """Rows (user_id, ordinal, user_name, folder)."""
    name = F.coalesce(F.nullif("name", F.lit("")), F.col("user_id").cast("string"))
    return users.select("user_id", "ordinal", F.col("name").alias("user_name"), safe_name(name).alias("folder"))


def folder_owners(users: DataFrame, served: DataFrame) -> DataFrame:
    """Rows (folder, category, user_id, user_name): whose lists the folders written by a run hold.

    `served` has the pairs (user_id, category) with candidates. Of several users of one folder
    the last by ordinal (then by id) owns it, also if nothing qualified for them: they empty it.
    """
    pairs = served.select("user_id", "category").distinct().join(user_folder(users).hint("merge"), "user_id")
    last = F.max(F.struct("ordinal", "user_id", "user_name")).alias("last")
    return pairs.groupBy("folder", "category").agg(last).select("folder", "category", "last.user_id", "last.user_name")


def owned_targets(top: DataFrame, owners: DataFrame, files: DataFrame, path: Column | None = None) -> DataFrame:
    """Rows (folder, category, target, action, source, doc), one a target: what the owners' lists need.

    `top` has user_id, category, position and item columns; `files` has item_id, rel_path,
    file_name and ext. Documents and links come from the same owner. Of several items for one
    target the later in the list wins, for copies and documents the first; of several files of an item that
    last by path, or for copies the first. A document wins over a copied file.
    """
    lists = top.drop("user_name").join(owners.hint("merge"), ["user_id", "category"])
    docs = sidecar_docs(lists).select("target", F.lit("write").alias("action"), F.lit(None).cast("string").alias("source"), "doc")
    rows = link_manifest(lists, files, path, by=["position"])
    first = F.col("action") == "copy"
    order = F.when(first, -F.col("position")).otherwise(F.col("position"))
    links = rows.groupBy("target").agg(F.max_by(F.struct("action", "source"), order).alias("won")).select("target", "won.action", "won.source", F.lit(None).cast("string").alias("doc"))
    links = links.join(docs.select("target").hint("merge"), "target", "left_anti")
    parts = F.split("target", "/")
    return links.unionByName(docs).select(parts[0].alias("folder"), parts[1].alias("category"), "target", "action", "source", "doc")


def target_changes(new: DataFrame, old: DataFrame, owners: DataFrame) -> DataFrame:
    """Rows (change, folder, category, target, action, source, doc): create, replace or delete.

    Only folders that the run writes (`owners`) lose targets; others stay as they are. The same
    run again changes nothing.
    """
    mine = old.join(owners.select("folder", "category").hint("merge"), ["folder", "category"], "left_semi")
    a, b = new.select(F.struct(*new.columns).alias("n"), F.col("target")), mine.select(F.struct(*new.columns).alias("o"), F.col("target"))
    both = a.join(b, "target", "full")
    what = lambda side: F.struct(f"{side}.action", f"{side}.source", f"{side}.doc")
    change = F.when(F.col("o").isNull(), "create").when(F.col("n").isNull(), "delete").when(~what("n").eqNullSafe(what("o")), "replace")
    return both.select(change.alias("change"), F.coalesce("n", "o").alias("row")).where("change IS NOT NULL").select("change", "row.*")


def with_changes(old: DataFrame, changes: DataFrame) -> DataFrame:
    """The state after the changes; applying them again gives the same state."""
    kept = old.join(changes.select("target").hint("merge"), "target", "left_anti")
    return kept.unionByName(changes.where("change <> 'delete'").drop("change"))
