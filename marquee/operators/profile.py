"""Taste profiles: weighted facets of what each user played."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import recency_tenths

WARM = 5


def facets(genres: DataFrame, people: DataFrame) -> DataFrame:
    """Rows (item_id, facet, value, weight): genres count 1, actors 2, directors 4; other people don't count."""
    kind = F.lower("type")
    cast = people.where(F.col("type").isin("Actor", "Director")).select("item_id", kind.alias("facet"), F.col("person").alias("value"), F.when(F.col("type") == "Actor", 2).otherwise(4).alias("weight"))
    return genres.select("item_id", F.lit("genre").alias("facet"), F.col("genre").alias("value"), F.lit(1).alias("weight")).unionByName(cast)


def accumulate(plays: DataFrame, item_facets: DataFrame, as_of: str, parts: int | None = None) -> DataFrame:
    """Rows (user_id, facet, value, num): summed weight times recency, in tenths, so that sums are exact.

    With `parts`, the rows are dealt out in so many partitions, by item and then by user; by user they stay.
    """
    dealt = lambda df, by: df if parts is None else df.repartition(parts, by)
    weighted = plays.select("user_id", "item_id", recency_tenths(F.col("last_played"), as_of).alias("tenths"))
    return dealt(dealt(weighted, "item_id").join(dealt(item_facets, "item_id"), "item_id"), "user_id").groupBy("user_id", "facet", "value").agg(F.sum((F.col("weight") * F.col("tenths")).cast("long")).alias("num"))


def facet_maxima(prefs: DataFrame) -> DataFrame:
    return prefs.groupBy("user_id", "facet").agg(F.max("num").alias("max_num"))


def normalise(prefs: DataFrame) -> DataFrame:
    """Adds max_num and pref = num / max_num in (0, 1], by user and facet."""
    return prefs.join(facet_maxima(prefs), ["user_id", "facet"]).withColumn("pref", F.col("num") / F.col("max_num"))


def user_collections(plays: DataFrame, items: DataFrame) -> DataFrame:
    return plays.select("user_id", "item_id").join(items.where("collection IS NOT NULL AND collection <> ''").select("item_id", "collection"), "item_id").select("user_id", "collection").distinct()


def warmth(users: DataFrame, plays: DataFrame) -> DataFrame:
    """Rows (user_id, n_plays, warm): warm with at least 5 played items."""
    n = plays.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    joined = users.select("user_id").join(n, "user_id", "left")
    return joined.select("user_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_plays"), (F.coalesce("n", F.lit(0)) >= WARM).alias("warm"))
