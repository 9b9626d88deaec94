"""Exact dedup by two-pass Bloom filtering.

The first pass writes each row's text digest and fills a counting Bloom filter whose bits grow
with the rows. The second pass looks each digest up: rows that are certainly alone pass straight
through, and only digests that may repeat shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import settled, written
from .text import pieces, utf8

#: Slots a row, and the bound of one filter (128 MB of bits, which every task gets): with more rows
#: the digests are dealt out by ranges of a hash, each with a filter of its own.
SLOTS_A_ROW, MOST_SLOTS, HASHES = 12, 1 << 30, 4
_SEGMENT = 1 << 16
#: Rows of a task that go into one partial filter.
_PART_ROWS = 1 << 20


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        data, offsets = utf8(batch.column("text"))
        lower = data.tobytes().lower()  # of bytes: A-Z only
        spans = zip(offsets[:-1].tolist(), offsets[1:].tolist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([hashlib.sha256(lower[a:b]).digest() for a, b in spans], pa.binary())], ["doc_id", "digest"])


def digests(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, digest): SHA-256 of the text with A-Z in lower case, null as empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_digests, f"doc_id {kind}, digest binary")


def slots_of(column: pa.Array, slots: int) -> np.ndarray:
    """The slots of each digest, one row for each; digests are of 32 bytes."""
    words = np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 4)
    return (words[:, :HASHES] % np.uint64(slots)).astype(np.int64)


def _partial(slots: int):
    """Partial filters as sorted places within each segment: those met, and those met twice."""

    def parts(at: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, n = np.unique(at, return_counts=True)
        segment = at // _SEGMENT
        first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        place, twice = (at % _SEGMENT).astype("<u2"), n > 1
        ends = np.append(first[1:], len(at))
        met = [place[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist())]
        again = [place[a:b][twice[a:b]].tobytes() for a, b in zip(first.tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(segment[first]), pa.array(met, pa.binary()), pa.array(again, pa.binary())], ["segment", "met", "again"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            # a digest's own slots count once, though two of its hashes may give the same one
            own = np.sort(slots_of(batch.column("digest"), slots), axis=1)
            fresh = np.ones(own.shape, bool)
            fresh[:, 1:] = own[:, 1:] != own[:, :-1]
            held.append(own[fresh])
            rows += batch.num_rows
            if rows >= _PART_ROWS:
                yield from parts(np.concatenate(held))
                held, rows = [], 0
        if rows:
            yield from parts(np.concatenate(held))

    return fill


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of slots met at least twice, a row for each segment of this task, sorted by segment."""

    def bits(segment: int, twice: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["segment", "twice"])

    own, once, twice = None, np.zeros(_SEGMENT, bool), np.zeros(_SEGMENT, bool)
    for batch in batches:
        for segment, met, again in zip(*(batch.column(c).to_pylist() for c in ("segment", "met", "again"))):
            if segment != own:
                if own is not None and twice.any():
                    yield bits(own, twice)
                own = segment
                once[:], twice[:] = False, False
            at = np.frombuffer(met, "<u2")
            twice[at] |= once[at]
            once[at] = True
            twice[np.frombuffer(again, "<u2")] = True
    if own is not None and twice.any():
        yield bits(own, twice)


def repeat_filter(keys: DataFrame, rows: int) -> tuple[np.ndarray, int]:
    """Packed bits of the slots that digests met at least twice, and the number of slots.

    Its size follows the rows, up to MOST_SLOTS.
    """
    slots = int(min(MOST_SLOTS, max(_SEGMENT, SLOTS_A_ROW * rows)))
    parts = max(1, min(-(-slots // _SEGMENT), int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    partial = keys.mapInArrow(_partial(slots), "segment long, met binary, again binary")
    merged = partial.repartition(parts, "segment").sortWithinPartitions("segment").mapInArrow(_merge, "segment long, twice binary")
    bits = np.zeros(-(-slots // _SEGMENT) * _SEGMENT // 8, np.uint8)
    for segment, twice in merged.toLocalIterator():
        at = segment * _SEGMENT // 8
        bits[at : at + len(twice)] = np.frombuffer(twice, np.uint8)
    return bits, slots


def _flag(shared, slots: int):
    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            at = slots_of(batch.column("digest"), slots)
            maybe = ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
            yield batch.append_column("maybe", pa.array(maybe))

    return flag


def flagged(keys: DataFrame) -> DataFrame:
    """The rows (doc_id, digest) with `maybe`: False for digests that are certainly alone.

    A filter's bits grow with the rows. Where all of them would exceed the bound of one
    broadcast, the narrow rows are dealt out by ranges of a hash (a hot digest over many tasks),
    and each range is filtered by itself, so that the share of lone rows taken for repeated
    ones stays the same at any size.
    """
    spark = keys.sparkSession
    schema = f"doc_id {keys.schema['doc_id'].dataType.simpleString()}, digest binary, maybe boolean"

    def one(table: DataFrame, rows: int) -> DataFrame:
        bits, slots = repeat_filter(table, rows)
        return table.mapInArrow(_flag(spark.sparkContext.broadcast(bits), slots), schema)

    rows = keys.count()
    ranges = -(-rows * SLOTS_A_ROW // MOST_SLOTS)
    if ranges <= 1:
        return one(keys, rows)
    dealt = keys.withColumns({"range": F.pmod(F.xxhash64("digest"), F.lit(ranges)).cast("int"), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(64))})
    dealt = written(dealt.repartition("range", "salt").drop("salt"), "digest-ranges", by="range")
    out = None
    for k in range(ranges):
        table = dealt.where(F.col("range") == k).drop("range")
        part = written(one(table, table.count()), "flagged")
        out = part if out is None else out.unionByName(part)
    return out


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one for each row of `docs`.

    Of texts that are equal after lower-casing A-Z, the row with the largest doc_id stays.
    A null text equals an empty one. Rows that repeat a doc_id count, and share its decision.
    A null doc_id is less than any other and stays only in a group of nulls. Other columns are
    ignored; an empty table gives no rows. A hot group is pre-aggregated by each task, and the
    join back is one that Spark splits where keys are skewed.
    """
    rows = flagged(written(digests(docs), "digests"))
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    alone = rows.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    again = rows.where("maybe").select("doc_id", "digest")
    groups = again.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = settled(groups, "groups")
    return alone.unionByName(again.join(groups, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), sha))
