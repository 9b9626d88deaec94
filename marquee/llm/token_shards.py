"""Token-ID output: one wavelet matrix per shard, in Parquet files in doc_id order."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokenizer_files
from .text import pieces, utf8
from .wavelet import WaveletMatrix

#: Text bytes a file, with some for each row; it bounds what a task holds, with the longest document.
SHARD_BYTES, ROW_BYTES = 16 << 20, 8
#: Shard starts are sent to all tasks up to this many shards (16 bytes each), else joined.
MOST_BROADCAST_SHARDS = 500_000
SHARD_SCHEMA = "part int, seq int, n_docs long, n_tokens long, width int, zeros array<long>, planes array<binary>, ranks array<binary>, doc_ids binary, null_ids binary, sizes binary"
_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()), ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())), ("doc_ids", pa.binary()), ("null_ids", pa.binary()), ("sizes", pa.binary())])


def _writer(raw: bytes, kind: str, version: str, end_id: int, shard_bytes: int):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId(), 0, 0
        ids, sizes, docs, nulls = [], [], [], []

        def shard() -> pa.RecordBatch:
            values = np.concatenate(ids)
            width = max(int(values.max()).bit_length(), 1) if len(values) else 1
            matrix = WaveletMatrix.build(values, width)
            n = np.concatenate(sizes)
            row = [part, seq, len(n), len(values), width, matrix.zeros, matrix.raw, matrix.ranks, np.concatenate(docs).astype("<i8").tobytes(), np.concatenate(nulls).tobytes(), n.astype("<i8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ARROW)], schema=_ARROW)

        for batch in pieces(batches):
            column = batch.column("text")
            data, offsets = utf8(column)
            tokens, at = tokenizer_files.ids_of(raw, kind, version, lambda c=column: [x or "" for x in c.to_pylist()], data, offsets)
            if end_id > np.iinfo(tokens.dtype).max:
                tokens = tokens.astype(np.uint32)
            ids.append(np.insert(tokens, at[1:], tokens.dtype.type(end_id)))
            sizes.append(np.diff(at) + 1)
            key = batch.column("doc_id")
            docs.append(key.fill_null(0).to_numpy(zero_copy_only=False))
            nulls.append(key.is_null().to_numpy(zero_copy_only=False))
            held += len(data) + ROW_BYTES * batch.num_rows
            if held >= 2 * shard_bytes:
                yield shard()
                seq, held, ids, sizes, docs, nulls = seq + 1, 0, [], [], [], []
        if ids:
            yield shard()

    return shards


def write_token_shards(docs: DataFrame, tokenizer_path: str, path: str, end_id: int, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode `docs` (doc_id, text) in ascending doc_id order into wavelet-matrix files at `path`.

    Texts are dealt out by ranges of doc_id before they are encoded, so that each is encoded
    once and a file holds neighbours. A null text is empty and still gets its end id; null ids
    come first; rows with equal ids (or none) are ordered by a hash of their texts, so that any
    number of them can be dealt out. Rows count too, so that empty texts fill files. Other columns are ignored.
    """
    raw, kind, version = tokenizer_files.load(tokenizer_path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES)).first()[0] or 0
    parts = max(1, -(-total // shard_bytes))
    ordered = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.drop("tie").mapInArrow(_writer(raw, kind, version, end_id, shard_bytes), SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["n_tokens"], row["width"], row["zeros"], row["planes"], row["ranks"])


def _reader(batches: Iterator[pa.RecordBatch], with_ids: bool, token: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            matrix = _matrix(row)
            ids = matrix.decode()
            sizes = np.frombuffer(row["sizes"], "<i8")
            ends = np.cumsum(sizes)
            little = ids.astype("<u4").tobytes()
            spans = list(zip((ends - sizes).tolist(), ends.tolist()))
            columns = [
                pa.array(np.full(len(sizes), row["part"], np.int32)),
                pa.array(np.full(len(sizes), row["seq"], np.int32)),
                pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["null_ids"], bool)),
                pa.array(ends - sizes),
                pa.array(sizes),
                pa.array([zlib.crc32(little[4 * a : 4 * b]) for a, b in spans], pa.int64()),
            ]
            names = ["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"]
            if token is not None:
                below = matrix.rank(np.array([token]), np.append(0, ends)) if token < 1 << row["width"] else np.zeros(len(ends) + 1, np.int64)
                columns.append(pa.array(np.diff(below)))
                names.append("n_of_token")
            if with_ids:
                columns.append(pa.array([ids[a:b].astype(np.int32) for a, b in spans], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)


def read_token_shards(spark: SparkSession, path: str, with_ids: bool = False, token: int | None = None) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32[, n_of_token][, ids]) from the files at `path`.

    The ids are decoded from the bit-planes; how often `token` occurs in each document comes from
    two ranks by the stored directories.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("shard_start"))
    if shards.select("part").count() <= MOST_BROADCAST_SHARDS:
        starts = F.broadcast(starts)
    more = {"n_of_token": "long"} if token is not None else {}
    more |= {"ids": "array<int>"} if with_ids else {}
    schema = "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long" + "".join(f", {c} {kind}" for c, kind in more.items())
    rows = shards.mapInArrow(lambda it: _reader(it, with_ids, token), schema).join(starts, ["part", "seq"])
    return rows.select("doc_id", (F.col("shard_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *more)


def _by_shard(look, schema: pa.Schema):
    """Runs look on each shard's row and matrix; only the planes' bytes and stored ranks are touched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                found = {"part": row["part"], "seq": row["seq"], **look(row, _matrix(row))}
                yield pa.RecordBatch.from_arrays([pa.array([found[f.name]], f.type) for f in schema], schema=schema)

    return run


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Rows (part, seq, count, positions): where a token occurs, by rank and select alone."""
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("count", pa.int64()), ("positions", pa.list_(pa.int64()))])

    def look(row: dict, matrix: WaveletMatrix) -> dict:
        at = matrix.occurrences(token) if token < 1 << row["width"] else np.zeros(0, np.int64)
        return {"count": len(at), "positions": at}

    return spark.read.schema(SHARD_SCHEMA).parquet(path).mapInArrow(_by_shard(look, schema), "part int, seq int, count long, positions array<long>")


def token_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """Rows (part, seq, within, token) for rows (part, seq, within) of `positions`, by access alone."""
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("within", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])

    def look(row: dict, matrix: WaveletMatrix) -> dict:
        at = np.array([p for p in row["asked"] if 0 <= p < row["n_tokens"]], np.int64)
        return {"within": at, "tokens": matrix.access(at)}

    asked = positions.groupBy("part", "seq").agg(F.collect_set(F.col("within").cast("long")).alias("asked"))
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path).join(asked, ["part", "seq"])
    found = shards.mapInArrow(_by_shard(look, schema), "part int, seq int, within array<long>, tokens array<long>")
    return found.select("part", "seq", F.explode(F.arrays_zip("within", "tokens")).alias("at")).select("part", "seq", "at.within", F.col("at.tokens").alias("token"))
