"""Policy changes as a log with sequence numbers, from which any state can be made again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import _folders

LOG = "user_id {kind}, folders array<string>, reason string, seq long"


def initial_state(users: DataFrame) -> DataFrame:
    """Rows (user_id, folders, seq): policies before any change of a log."""
    return users.select("user_id", F.col("enabled_folders").alias("folders"), F.lit(0).cast("long").alias("seq"))


def as_changes(feed: DataFrame, reason: str, seq: int, folders: str = "new_folders") -> DataFrame:
    """The rows of an audit's feed as changes of one sequence number; a user has at most one in each."""
    return feed.select("user_id", F.col(folders).alias("folders"), F.lit(reason).alias("reason"), F.lit(seq).cast("long").alias("seq"))


def apply_changes(state: DataFrame, changes: DataFrame, until: int | None = None) -> DataFrame:
    """The state after the changes (up to `until`), whatever of them it has already seen.

    A change counts for a user whose state is older than it; of several the last one wins, as each holds the
    whole list. So changes may come twice, in pieces and in any order of pieces, as long as a
    later piece holds no change that an applied one of a greater number for the same user should
    have followed. Changes of unknown users are left out.
    """
    upto = changes if until is None else changes.where(F.col("seq") <= until)
    last = upto.groupBy("user_id").agg(F.max_by(F.struct("folders", "seq"), "seq").alias("change"))
    joined = state.join(last, "user_id", "left")
    newer = F.coalesce(F.col("change.seq") > F.col("seq"), F.lit(False))
    pick = lambda c: F.when(newer, F.col(f"change.{c}")).otherwise(F.col(c)).alias(c)
    return joined.select("user_id", pick("folders"), pick("seq"))


def append_changes(changes: DataFrame, path: str) -> None:
    """Add changes to the log at `path`, a folder for each sequence number; the same number again replaces it whole."""
    numbers = [r.seq for r in changes.select("seq").distinct().collect()]  # runs
    for seq in numbers:
        changes.where(F.col("seq") == seq).drop("seq").write.mode("overwrite").parquet(f"{path}/seq={seq:012d}")


def read_changes(spark: SparkSession, path: str, after: int = 0, until: int | None = None) -> DataFrame:
    """The log's changes with after < seq <= until; only their folders are read."""
    found = [int(f.removeprefix("seq=")) for f in _folders(spark, path) if f.startswith("seq=")]
    wanted = [n for n in found if n > after and (until is None or n <= until)]
    if not wanted:
        return spark.createDataFrame([], LOG.format(kind="long"))
    return spark.read.option("basePath", path).parquet(*[f"{path}/seq={n:012d}" for n in wanted]).withColumn("seq", F.col("seq").cast("long"))
