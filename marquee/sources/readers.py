"""Readers with fixed schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .log_files import split_lines

PLAYS = "user_id string, item_id string, last_played string"
USERS = "user_id string, name string, ordinal int, enabled_folders array<string>, enable_all boolean"
LIBRARIES = "item_id string, name string, collection_type string, locations array<string>"
VIEW_ITEMS = "item_id string, name string, type string"
FACTORS = ("genres", "actors", "directors", "community", "collection", "seen_penalty", "diversity")
# Default weights by category, in the order of FACTORS.
DEFAULT_WEIGHTS = {
    "Movies": (1.0, 1.5, 2.5, 2.0, 5.0, 10.0, 1.2),
    "Shows": (1.5, 2.0, 1.0, 1.5, 3.0, 6.0, 1.0),
    "Music": (2.0, 0.0, 0.0, 1.0, 2.0, 4.0, 0.8),
}
# Default categories (name, enabled, discovery name, least score, collection type, item type).
DEFAULT_CATEGORIES = [
    ("Movies", True, "Discover Movies", 5.0, "movies", "Movie"),
    ("Shows", True, "Discover Shows", 5.0, "tvshows", "Series"),
    ("Music", True, "Discover Music", 0.0, "music", "MusicAlbum"),
]
CATEGORY_SCHEMA = "category string, enabled boolean, discovery_name string, min_score double, api_type string, item_type string"
WEIGHT_SCHEMA = "category string, " + ", ".join(f"{f} double" for f in FACTORS)


def cap_plays(plays: DataFrame, limit: int = 3000) -> DataFrame:
    """At most `limit` plays of each user: the most recent, then by item."""
    order = Window.partitionBy("user_id").orderBy(F.col("last_played").desc_nulls_last(), "item_id")
    return plays.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")


def read_plays(spark: SparkSession, path: str, per_user_limit: int = 3000) -> DataFrame:
    return cap_plays(spark.read.schema(PLAYS).json(path), per_user_limit)


def read_libraries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LIBRARIES).json(path)


def read_users(summary: DataFrame, full: DataFrame) -> DataFrame:
    """Users of the summary list; where the full record has a policy, it wins."""
    policy = full.select("user_id", F.col("enabled_folders").alias("full_folders"), F.col("enable_all").alias("full_all"))
    joined = summary.join(policy, "user_id", "left")
    return joined.select("user_id", "name", "ordinal", F.coalesce("full_folders", "enabled_folders").alias("enabled_folders"), F.coalesce("full_all", "enable_all").alias("enable_all"))


def read_view_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VIEW_ITEMS).json(path).where(F.col("type").isin("CollectionFolder", "UserView")).select("item_id", "name")


def default_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, *w) for c, w in DEFAULT_WEIGHTS.items()], WEIGHT_SCHEMA)


def default_categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_CATEGORIES, CATEGORY_SCHEMA)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """Weights by category from {"SCORING": {"DISCOVERY_BIAS": {category: {factor: weight}}}}.

    A category or factor that the file lacks has its default; an unreadable or empty file is all
    defaults.
    """
    kind = "SCORING struct<DISCOVERY_BIAS: map<string, map<string, double>>>"
    given = spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("SCORING.DISCOVERY_BIAS").alias("category", "w"))
    joined = default_weights(spark).join(given, "category", "full")
    movies = dict(zip(FACTORS, DEFAULT_WEIGHTS["Movies"]))
    return joined.select("category", *[F.coalesce(F.col("w")[f], F.col(f), F.lit(movies[f])).alias(f) for f in FACTORS])


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """Categories from {"CATEGORIES": {name: {...}}}; an unreadable file gives none."""
    kind = "CATEGORIES map<string, struct<enabled: boolean, discovery_name: string, min_community_score: double>>"
    given = spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("CATEGORIES").alias("category", "c"))
    types = default_categories(spark).select("category", "api_type", "item_type")
    return given.join(types, "category").select("category", F.coalesce("c.enabled", F.lit(False)).alias("enabled"), "c.discovery_name", F.col("c.min_community_score").alias("min_score"), "api_type", "item_type")


def read_logs(spark: SparkSession, path: str, glob: str = "*.log") -> DataFrame:
    """Lines (file, modified, line_no, line) of all *.log files, numbered from 0 in each file; large files are split."""
    return split_lines(spark, path, glob)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Inventory (path, size, file_name, ext) below a folder; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.col("length").alias("size"), name.alias("file_name"), F.lower(F.regexp_extract(name, r"[^.]\.([^.]*)$", 1)).alias("ext"))
