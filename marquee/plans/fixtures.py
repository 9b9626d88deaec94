"""The library's tables, derived from the star-schema test tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import ZERO_WIDTH
from ..sources.readers import default_categories, default_weights

AS_OF = "2001-08-02 00:00:00"
EVENTS_AS_OF = "2024-02-15 12:00:00"
ROOT = "/srv/discovery"


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder's path in spark.checkpoint.dir; in a temporary folder only in local mode."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="marquee-")
    return f"{top.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


#: Rows of a table for each partition of what is derived from it.
PART_ROWS = 250_000


class Library:
    """Lazy tables over one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, stream: bool = False):
        self.spark, self.sf_dir, self.stream = spark, sf_dir, stream

    def snapshot(self, df: DataFrame, tag: str) -> DataFrame:
        """The rows as a written table, which a run reads several times instead of deriving them anew."""
        path = shared_path(self.spark, tag)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        found = self.spark.read.parquet(path)
        if not self.stream:
            return found
        files = self.spark.readStream.schema(found.schema).parquet
        return files(path if len(found.inputFiles()) > 1 or not found.inputFiles()[0].endswith(f"/{name}.parquet") else f"{path}*")

    def parts(self, name: str) -> int:
        """Partitions in proportion to a table's rows, which its files know, so that no task grows with it."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.table(name).count() // PART_ROWS))

    def users(self) -> DataFrame:
        key = F.col("c_custkey")
        folder = lambda n: F.concat(F.lit("lib"), n.cast("string"))
        first = folder(key % 25)
        return self.table("customer").select(key.alias("user_id"), F.col("c_name").alias("name"), key.cast("int").alias("ordinal"), F.array(first, folder((key + 7) % 30), first).alias("enabled_folders"), F.lit(True).alias("enable_all"))

    def items(self) -> DataFrame:
        key = F.col("p_partkey")
        kind = F.split_part("p_type", F.lit(" "), F.lit(1))
        category = F.when(kind.isin("ECONOMY", "LARGE"), "Movies").when(kind.isin("MEDIUM", "PROMO"), "Shows").otherwise("Music")
        path = F.concat(F.lit("/media/"), category, F.lit("/"), F.col("p_name"), F.lit("-"), key.cast("string"), F.when(key % 5 == 0, ".mkv").otherwise(""))
        return self.table("part").select(
            key.alias("item_id"), F.col("p_name").alias("name"), F.when(key % 11 != 0, path).alias("path"), category.alias("category"),
            F.when(key % 7 != 0, F.col("p_size").cast("double") / F.lit(5.0)).alias("rating"), F.when(key % 3 == 0, F.col("p_brand")).alias("collection"),
            F.when(key % 2 == 0, F.col("p_brand")).otherwise("").alias("album_artist"), F.when(key % 4 == 1, F.array("p_type")).otherwise(F.array().cast("array<string>")).alias("artists"), (key % 5 != 0).alias("is_folder"),
        )

    def item_genres(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("item_id"), F.explode(F.array(F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)))).alias("genre"))

    def item_people(self) -> DataFrame:
        n = F.col("l_linenumber")
        kind = F.when(n == 1, "Director").when(n <= 3, "Actor").otherwise("Writer")
        rows = self.table("lineitem").where(n <= 4).select(F.col("l_partkey").alias("item_id"), F.col("l_suppkey").cast("string").alias("person"), kind.alias("type"))
        return rows.repartition(self.parts("lineitem"), "item_id").distinct()

    def plays(self) -> DataFrame:
        parts = self.parts("lineitem")
        when = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("timestamp_ntz"))
        orders = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), when.alias("played")).repartition(parts, "o_orderkey")
        firsts = self.table("lineitem").where("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("item_id")).repartition(parts, "l_orderkey")
        joined = orders.join(firsts, F.col("o_orderkey") == F.col("l_orderkey")).repartition(parts, "user_id")
        return joined.groupBy("user_id", "item_id").agg(F.max("played").alias("last_played"))

    def event_plays(self) -> DataFrame:
        item = F.get_json_object("props", "$.k").cast("long")
        return self.table("events").groupBy("user_id", item.alias("item_id")).agg(F.max(F.col("ts").cast("timestamp_ntz")).alias("last_played"))

    def categories(self) -> DataFrame:
        return default_categories(self.spark)

    def weights(self) -> DataFrame:
        return default_weights(self.spark)

    def libraries(self) -> DataFrame:
        key = F.col("n_nationkey")
        kind = key % 5
        folder = F.concat(F.lit("Customer"), F.lpad((key * 3).cast("string"), 9, "0"))  # a user's safe name
        name = F.when(kind == 0, F.col("n_name")).when(kind == 1, F.lit("Discover Movies" + ZERO_WIDTH)).when(kind == 2, F.lit("Discover Old")).when(kind == 3, F.lit("Recommended X")).otherwise(F.concat(F.lit("Plain "), F.col("n_name")))
        place = F.when(kind == 0, F.array(F.concat(F.lit("/media/"), F.col("n_name")))).when(kind == 4, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("/SRV/Discovery/"), folder, F.lit("/Movies"))))
        types = F.when(key % 3 == 0, "movies").when(key % 3 == 1, "tvshows").otherwise("music")
        return self.table("nation").select(F.concat(F.lit("lib"), key.cast("string")).alias("item_id"), name.alias("name"), types.alias("collection_type"), place.alias("locations"), key.alias("ordinal"))

    def files(self) -> DataFrame:
        names = ["a.mkv", "a.mp4", "cover.jpg", "notes.txt", "song.flac"]
        return self.table("part").select(F.col("p_partkey").alias("item_id"), F.lit("").alias("rel_path"), F.explode(F.array(*map(F.lit, names))).alias("file_name")).withColumn("ext", F.element_at(F.split("file_name", r"\."), -1))

    def housemates(self) -> DataFrame:
        """Users of whom several have the same safe name."""
        return self.users().withColumn("name", F.concat(F.lit("House: "), (F.col("user_id") % 400).cast("string")))

    def nested_items(self) -> DataFrame:
        """Items, some with items of their own below their folder: a folder, and a file within that."""
        items = self.items().select("item_id", "name", "category", "path", "album_artist", "artists", "is_folder")
        extras = items.where("item_id % 6 = 1 AND is_folder").withColumns({"item_id": F.col("item_id") + 1_000_000, "name": F.concat("name", F.lit(" Extras")), "path": F.concat("path", F.lit("/Extras"))})
        bonus = items.where("item_id % 12 = 1 AND is_folder").withColumns({"item_id": F.col("item_id") + 2_000_000, "name": F.concat("name", F.lit(" Bonus")), "path": F.concat("path", F.lit("/Extras/bonus.mkv")), "is_folder": F.lit(False)})
        return items.unionByName(extras).unionByName(bonus)

    def paths(self) -> DataFrame:
        """An inventory of files: below items, items that are files, and files below no item."""
        names = ["a.mkv", "a.mp4", "cover.jpg", "notes.txt", "song.flac", "Extras/b.mkv", "Extras/bonus.mkv", "Extras/deep/c.flac"]
        items = self.items()
        below = items.where("is_folder AND path IS NOT NULL").select("path", F.explode(F.array(*map(F.lit, names))).alias("name")).select(F.concat_ws("/", "path", "name").alias("path"))
        loose = items.where("item_id % 11 = 0").select(F.concat(F.lit("/media/Loose/"), F.col("item_id").cast("string"), F.lit(".mkv")).alias("path"))
        every = below.unionByName(items.where("NOT is_folder AND path IS NOT NULL").select("path")).unionByName(loose)
        name = F.element_at(F.split("path", "/"), -1)
        return every.select("path", name.alias("file_name"), F.element_at(F.split(name, r"\."), -1).alias("ext"))

    def play_lists(self, items: DataFrame | None = None, plays: DataFrame | None = None) -> DataFrame:
        """Lists of what each user played, nested items (whose ids are above a million) behind their item's: a small published table."""
        of_item = F.col("item_id") if items is None else F.col("item_id") % 1_000_000
        items = self.items() if items is None else items
        of = (self.plays() if plays is None else plays).select("user_id", F.col("item_id").alias("played"))
        order = Window.partitionBy("user_id", "category").orderBy("item_id")
        joined = items.where("path IS NOT NULL").join(of.hint("merge"), F.col("played") == of_item).drop("played")
        return joined.withColumn("position", F.row_number().over(order))

    def library_items(self) -> DataFrame:
        """Items with the library they lie in and their type."""
        key = F.col("item_id")
        kind = F.when(F.col("category") == "Movies", "Movie").when(F.col("category") == "Shows", "Series").otherwise("MusicAlbum")
        return self.items().withColumns({"library_id": F.concat(F.lit("lib"), (key % 25).cast("string")), "item_type": kind})

    def log_lines(self) -> DataFrame:
        """Lines with the time of each; a file was modified at its last."""
        level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
        line = F.concat(F.lit("run ["), level, F.lit("] "), F.col("event_type"), F.lit(" "), F.floor("value").cast("string"))
        return self.table("events").select(F.concat(F.lit("log"), (F.col("user_id") % 10).cast("string")).alias("file"), F.col("event_id").alias("line_no"), line.alias("line"), F.col("ts").alias("modified"))
