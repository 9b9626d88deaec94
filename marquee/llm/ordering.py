"""One order over all partitions: rows sorted by ranges and numbered."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .text import tidy


def _numbered(batches: Iterator[pa.RecordBatch], count: str | None) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the rows (or the sum of `count`) before each row in it."""
    from pyspark import TaskContext

    tidy()
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column(count).to_numpy(zero_copy_only=False) if count else np.ones(batch.num_rows, np.int64)
        ends = before + np.cumsum(n)
        yield batch.append_column("part", pa.array(np.full(batch.num_rows, part, np.int32))).append_column("before", pa.array(ends - n))
        before = int(ends[-1]) if len(ends) else before


def dealt(rows: DataFrame, order: list[str], tag: str, count: str | None = None) -> DataFrame:
    """The rows sorted over all partitions, with `before`: the number of rows (or sum of counts) that come before each."""
    kinds = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes)
    table = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda it: _numbered(it, count), f"{kinds}, part int, before long"), tag)
    totals = table.groupBy("part").agg(F.sum(F.lit(1) if count is None else F.col(count)).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))  # one row a partition
    return table.join(F.broadcast(bases), "part").withColumn("before", F.col("base") + F.col("before")).drop("part", "base")
