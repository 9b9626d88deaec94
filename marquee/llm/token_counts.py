"""Token counts through a digest cache.

Content digests are joined to counts stored for the same tokenizer file; only distinct texts
without a stored count are encoded, and their counts are appended to the cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizer_files
from .store import written
from .text import pieces, utf8

#: Missing digests (64 bytes each) are sent to all tasks up to this number, else they meet the texts in a shuffled join.
MOST_BROADCAST_DIGESTS = 500_000
CACHE_SCHEMA = "digest string, n_tokens long, tokenizer string"


def _counter(raw: bytes, kind: str, version: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer_files.coder(raw, kind, version)
        for batch in pieces(batches):
            column = batch.column("text")
            data, offsets = utf8(column)
            if own is not None:
                n = own.counts(data, offsets)
            else:
                _, at = tokenizer_files.ids_of(raw, kind, version, lambda c=column: [x or "" for x in c.to_pylist()], data, offsets)
                n = np.diff(at)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return count


def stored(spark, cache_path: str, version: str, asked: DataFrame | None = None) -> DataFrame | None:
    """The counts stored for a tokenizer version, one row per digest (only those of `asked`); None without a cache."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{cache_path}/tokenizer={version}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    if asked is not None:
        cache = cache.join(asked.select("digest"), "digest", "left_semi")
    return cache.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 512) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit, digest), one for each row of `docs`.

    The normal form of a text is the text itself, as any change could change its count; null
    counts as empty. Columns beside doc_id and text are ignored. Equal texts (also a large
    group of them) are encoded once: they meet as one row per task. Repeated rows and null ids
    stay; an empty table gives no rows. Of the cache only the tokenizer's folder is read, and only
    the digests asked for are kept; up to 500,000 missing ones, no other text is shuffled. Appending twice
    after a failure is harmless, as the cache is read with one row per digest. An unknown
    tokenizer file is a new version.
    """
    raw, kind, version = tokenizer_files.load(tokenizer_path)
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
    narrow = written(keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")
    asked = narrow.select("digest").distinct()
    known = stored(spark, cache_path, version, asked)
    known = None if known is None else written(known, "known-counts")
    missing = None if known is None else written(asked.join(known, "digest", "left_anti"), "missing")
    n = 0 if missing is None else missing.count()
    if known is None or n:
        texts = keyed.select("digest", "text")
        if n:  # the digests are found first, so that only texts to be encoded shuffle
            texts = texts.join(F.broadcast(missing) if n <= MOST_BROADCAST_DIGESTS else missing, "digest", "left_semi")
        misses = texts.dropDuplicates(["digest"])
        counted = written(misses.mapInArrow(_counter(raw, kind, version), "digest string, n_tokens long"), "counted")
        counted.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
        known = counted if known is None else known.unionByName(counted)
    return narrow.join(known, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "digest")
