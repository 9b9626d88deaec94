"""Shards along a Hilbert curve over metadata, cut into runs that can be pruned by several dimensions.

Dimensions are quantised into cells of about equal counts. Rows are sorted by the index of their
cell on the curve, which keeps rows that are near in all dimensions near in the order, and the
order is cut into shards of equal counts. All of it is DataFrame expressions.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DIMENSIONS, BITS = ("lang", "source", "n_chars"), 6
SHARDS, RUN_BYTES = 24, 128 << 20
#: The table of files is sent to all tasks up to this many files (some 40 bytes each), else joined.
MOST_BROADCAST_FILES = 500_000
#: Bytes of a string that tell cells apart, after the prefix that all values share.
_STRING_BYTES = 6
_INDEX_BITS = 33  # of monotonically_increasing_id, below the partition's number


def _key(value: Column, kind: str, shared: int) -> Column:
    """A double in the order of the values; strings by some bytes after the `shared` first ones."""
    if kind == "string":
        digits = F.rpad(F.hex(F.substring(F.encode(value, "utf-8"), shared + 1, _STRING_BYTES)), 2 * _STRING_BYTES, "0")
        return F.conv(digits, 16, 10).cast("double")
    if kind == "date":
        return F.unix_date(value).cast("double")
    if kind == "boolean":
        return value.cast("int").cast("double")
    if kind.startswith(("array", "map", "struct", "binary")):
        raise ValueError(f"a dimension of type {kind} has no order on the curve")
    return value.cast("double")


def quantisers(rows: DataFrame, dimensions: list[str], bits: int = BITS) -> dict[str, Column]:
    """For each dimension a column with its cell, from 0 (null) to 2 ** bits - 1, of about equal counts.

    Limits are estimated quantiles of all rows (rank error 1 / 10,000), at most 2 ** bits numbers a
    dimension. They shape the order only: a shard's counts don't depend on them. A value that
    holds many rows is one cell.
    """
    kinds = {d: rows.select(d).schema[0].dataType.simpleString() for d in dimensions}
    texts = [d for d in dimensions if kinds[d] == "string"]
    shared = dict.fromkeys(dimensions, 0)
    if texts:
        ends = rows.agg(*[f(d).alias(f"{name}{i}") for i, d in enumerate(texts) for f, name in ((F.min, "low"), (F.max, "high"))]).first()
        shared |= {d: len(os.path.commonprefix([(ends[f"{name}{i}"] or "").encode() for name in ("low", "high")])) for i, d in enumerate(texts)}
    keys = {d: _key(F.col(d), kinds[d], shared[d]) for d in dimensions}
    at = [k / (2**bits - 1) for k in range(1, 2**bits - 1)]
    limits = rows.agg(*[F.percentile_approx(keys[d], at, 10_000).alias(f"limits{i}") for i, d in enumerate(dimensions)]).first()
    cells = {}
    for i, d in enumerate(dimensions):
        own = sorted(set(limits[f"limits{i}"] or []))
        steps = F.array(*map(F.lit, own)) if own else F.array().cast("array<double>")
        key = keys[d]
        cells[d] = F.when(key.isNull(), 0).otherwise(1 + F.size(F.filter(steps, lambda limit: limit <= key)))  # noqa: B023 - called at once
    return cells


def with_curve(rows: DataFrame, cells: list[Column], bits: int, name: str = "curve") -> DataFrame:
    """Adds the Hilbert index of the cells, which are integers below 2 ** bits.

    The axes are turned into the curve's own by one step a bit and axis, each a projection of its
    own so that no expression is repeated; then their bits are interleaved.
    """
    x = [f"_axis{i}" for i in range(len(cells))]
    out = rows.withColumns({c: cell.cast("long") for c, cell in zip(x, cells)})
    col = F.col
    for bit in range(bits - 1, 0, -1):
        low = F.lit((1 << bit) - 1).cast("long")
        for c in x:
            is_set = F.shiftright(col(c), bit).bitwiseAND(F.lit(1).cast("long")) == 1
            if c == x[0]:
                out = out.withColumn(c, F.when(is_set, col(c).bitwiseXOR(low)).otherwise(col(c)))
                continue
            swap = col(x[0]).bitwiseXOR(col(c)).bitwiseAND(low)
            out = out.withColumns({x[0]: F.when(is_set, col(x[0]).bitwiseXOR(low)).otherwise(col(x[0]).bitwiseXOR(swap)), c: F.when(is_set, col(c)).otherwise(col(c).bitwiseXOR(swap))})
    for before, c in zip(x, x[1:]):
        out = out.withColumn(c, col(c).bitwiseXOR(col(before)))
    turn = F.lit(0).cast("long")
    for bit in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(F.shiftright(col(x[-1]), bit).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit((1 << bit) - 1).cast("long")).otherwise(F.lit(0).cast("long")))
    out = out.withColumn("_turn", turn)
    index = F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        for c in x:
            index = F.shiftleft(index, 1).bitwiseOR(F.shiftright(col(c).bitwiseXOR(col("_turn")), bit).bitwiseAND(F.lit(1).cast("long")))
    return out.withColumn(name, index).drop(*x, "_turn")


def write_shards(docs: DataFrame, path: str, dimensions: tuple[str, ...] = DIMENSIONS, shards: int = SHARDS, bits: int = BITS, run_bytes: int = RUN_BYTES) -> None:
    """Write all rows of `docs` in curve order to Parquet under path/rows, and what each file and run holds.

    One shuffle by ranges of (curve index, doc_id, text) deals rows out, so that neither a hot
    cell nor a group of copies has to lie in one task. path/files has a row a file with the number of rows
    before it; path/runs a row for each piece of a shard in a file, with its least and greatest
    value of each dimension. Shards have counts at most one apart. Dimensions that `docs` lacks
    are left out; nulls are cells of their own and a null text counts as none; repeated rows each
    take a place; other columns come along, whatever their names; an empty table makes no runs.
    """
    used = [d for d in dimensions if d in docs.columns]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    size = F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long") + 8
    total = rows.agg(F.sum(size)).first()[0] or 0
    cells = quantisers(rows, [f"row.`{d}`" for d in used], bits) if used else {"": F.lit(0)}
    placed = with_curve(rows.withColumns({"size": size, "tie": F.xxhash64("row.text")}), list(cells.values()), bits)
    order = ["curve", "row.doc_id", "tie"]
    ordered = placed.repartitionByRange(max(shards, -(-total // run_bytes)), *order).sortWithinPartitions(*order)
    ordered.drop("tie").withColumn("at", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{path}/rows")

    spark = docs.sparkSession
    written = spark.read.parquet(f"{path}/rows").withColumn("part", F.shiftright("at", _INDEX_BITS))
    counts = written.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = counts.select("part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"), F.lit(shards).alias("shards"))
    files.write.parquet(f"{path}/files")
    ends = [f(f"row.`{d}`").alias(f"{name}_{d}") for d in used for f, name in ((F.min, "low"), (F.max, "high"))]
    numbered = _numbered(spark, path, written.withColumn("file", F.col("_metadata.file_name")))
    numbered.groupBy("shard", "part", "file").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("slot").alias("first_slot"), *ends).write.parquet(f"{path}/runs")


def _numbered(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Adds shard and slot to rows with `at` and `part`: a row's number is that in its file and the rows before the file."""
    files = spark.read.parquet(f"{path}/files").drop("n")
    if files.count() <= MOST_BROADCAST_FILES:
        files = F.broadcast(files)
    number = F.col("at").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1)) + F.col("base")
    shard = F.expr("number * shards DIV total")
    first = F.expr("(shard * total + shards - 1) DIV shards")  # the least number of the shard
    return rows.join(files, "part").withColumn("number", number).withColumn("shard", shard).withColumn("slot", F.col("number") - first).withColumn("shard", F.col("shard").cast("int")).drop("base", "total", "shards", "number")


def read_shards(spark: SparkSession, path: str, within: dict[str, tuple] | None = None, shards: list[int] | None = None) -> DataFrame:
    """Rows (row, size, curve, shard, slot) from the files at `path`, `row` having the documents' columns.

    `within` has the least and greatest value of dimensions, `shards` the shards wanted; only
    files with a run that can hold such rows are read.
    """
    folder = f"{path}/rows"
    rows = spark.read.parquet(folder)
    if within is not None or shards is not None:
        runs = spark.read.parquet(f"{path}/runs")
        for d, (low, high) in (within or {}).items():
            runs = runs.where((F.col(f"high_{d}") >= F.lit(low)) & (F.col(f"low_{d}") <= F.lit(high)))
            rows = rows.where(F.col(f"row.`{d}`").between(low, high))
        if shards is not None:
            runs = runs.where(F.col("shard").isin(*shards) if shards else F.lit(False))
        names = [r.file for r in runs.select("file").distinct().collect()]  # as Spark's own list of files
        if not names:
            rows = rows.limit(0)
        else:
            wanted = spark.read.schema(rows.schema).parquet(*[f"{folder}/{name}" for name in names])
            for d, (low, high) in (within or {}).items():
                wanted = wanted.where(F.col(f"row.`{d}`").between(low, high))
            rows = wanted
    found = _numbered(spark, path, rows.withColumn("part", F.shiftright("at", _INDEX_BITS))).drop("at", "part")
    return found.where(F.col("shard").isin(*shards)) if shards else found
