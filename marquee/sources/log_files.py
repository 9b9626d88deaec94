"""Log files: lines with exact numbers from splits of a file, and the last lines by ranged reads."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

TAIL = "file string, modified timestamp, from_end int, line string, bytes_read long"


def split_lines(spark: SparkSession, path: str, glob: str = "*.log", name: Column | None = None) -> DataFrame:
    """Lines (file, modified, line_no, line) of all files, numbered from 0 in each file, read in splits.

    A line belongs to the split in which it begins. Each split numbers its own lines, and the
    counts of the splits before it (a row a split) are added. So a file of any size is read by
    many tasks, and no task holds more than a split. `name` is a column by which files are called, by default the
    file's name. Lines end with \\n or \\r\\n; an empty file has none.
    """
    text = spark.read.option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    where = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    called = F.col("_metadata.file_name") if name is None else name
    rows = text.select(*where, called.alias("file"), F.col("_metadata.file_modification_time").alias("modified"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\r$", "").alias("line"))
    within = F.row_number().over(Window.partitionBy("path", "block").orderBy("at")).cast("long") - 1
    counts = text.select(*where).groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    bases = counts.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = rows.withColumn("within", within).join(bases, ["path", "block"])
    return numbered.select("file", "modified", (F.col("base") + F.col("within")).alias("line_no"), "line")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _last_lines(read, size: int, n: int, block: int) -> tuple[list[bytes], int]:
    """The last n lines of `size` bytes, and how many bytes were read; read(a, b) gives the bytes a to b."""
    parts: list[bytes] = []
    at, breaks = size, 0
    while at > 0 and breaks <= n:  # one break more than lines: the last line may end with one
        start = max(0, at - block)
        parts.append(read(start, at))
        breaks += parts[-1].count(b"\n")
        at, block = start, 2 * block  # a longer line needs fewer, larger reads
    data = b"".join(reversed(parts))
    lines = data.removesuffix(b"\n").split(b"\n") if data else []
    return lines[-n:] if n else [], size - at


class _TailReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.glob = options["path"], options.get("glob", "*.log")
        self.n, self.block = int(options.get("lines", 100)), int(options.get("blockbytes", 1 << 16))
        self.latest = options.get("latest", "false").lower() == "true"

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)

    def partitions(self) -> list[InputPartition]:
        from fnmatch import fnmatch

        from pyarrow import fs

        files, root = self._files()
        about = files.get_file_info(root)
        found = [about] if about.type == fs.FileType.File else [f for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.File]
        found = [f for f in found if fnmatch(f.base_name, self.glob)]
        if self.latest and found:
            found = [max(found, key=lambda f: (f.mtime_ns, f.base_name))]
        return [_File(f.path) for f in found]

    def read(self, partition: _File | None) -> Iterator[tuple]:
        if partition is None:  # no files
            return
        files, _ = self._files()
        about = files.get_file_info(partition.path)
        with files.open_input_file(partition.path) as source:
            lines, bytes_read = _last_lines(lambda a, b: source.read_at(b - a, a), about.size, self.n, self.block)
        for k, line in enumerate(reversed(lines), 1):
            yield about.base_name, about.mtime, k, line.removesuffix(b"\r").decode("utf-8", "replace"), bytes_read


class TailSource(DataSource):
    """spark.read.format("log_tail"): rows (file, modified, from_end, line, bytes_read) of the last lines of files.

    Options: glob ("*.log"), lines (100), blockbytes (65536), latest (only the file modified
    last). Each file is a task, which reads blocks from the file's end until it has enough lines,
    so what is read follows the lines wanted and not the file. Paths are local or of a store that
    pyarrow.fs opens.
    """

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return TAIL

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TailReader(dict(self.options))


def read_tail(spark: SparkSession, path: str, n: int = 100, latest: bool = False, glob: str = "*.log", block_bytes: int = 1 << 16) -> DataFrame:
    """The last n lines of each log file, or of that modified last (ties: the last by name)."""
    spark.dataSource.register(TailSource)
    return spark.read.format("log_tail").options(glob=glob, lines=n, latest=latest, blockbytes=block_bytes).load(path)
