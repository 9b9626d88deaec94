"""Several passes over the same texts, each with a broadcast of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written


def in_passes(docs: DataFrame, values: Iterator[object], scan: Callable, out: str, found: str, merged: list[Column]) -> DataFrame:
    """Rows (doc_id, ...) of scan over `docs` (doc_id, text) for each value, put together for each row.

    scan(broadcast) gives a function for mapInArrow from (doc_id, text) to doc_id and the columns
    of `out`. One value is one pass. With more, rows are numbered and written once; each pass writes
    what it finds (rows that meet `found`; the first one all rows) and its broadcast is destroyed,
    so that any number of values takes one Python worker a task and the memory of one value.
    `merged` are the aggregates by which the columns of a row's passes become one.
    """
    context, kind = docs.sparkSession.sparkContext, docs.schema["doc_id"].dataType.simpleString()
    first, second = next(values), next(values, None)
    if second is None:
        return docs.select("doc_id", "text").mapInArrow(scan(context.broadcast(first)), f"doc_id {kind}, {out}")
    rows = written(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_no")), "numbered-texts")
    texts = rows.select(F.col("row_no").alias("doc_id"), "text")
    parts = None
    for k, value in enumerate(_chain(first, second, values)):
        shared = context.broadcast(value)
        part = texts.mapInArrow(scan(shared), f"doc_id long, {out}")
        part = written(part if k == 0 else part.where(found), "pass")
        shared.destroy()
        parts = part if parts is None else parts.unionByName(part)
    each = parts.groupBy(F.col("doc_id").alias("row_no")).agg(*merged)
    return rows.select("row_no", "doc_id").join(each, "row_no").drop("row_no")


def _chain(first: object, second: object, rest: Iterator[object]) -> Iterator[object]:
    yield first
    yield second
    yield from rest
