"""Tables that cut lineage: written to the folder which the whole cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar, Token

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one is made only in local mode."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="marquee-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Scope:
    """The tables that one run makes: `with Scope() as own: ...`, and own.clear(spark) once its results are saved.

    Scopes nest, and a table belongs to the innermost one. Each thread and each query has its own,
    so that no run deletes what another one made; tables made outside any scope are left alone.
    """

    def __init__(self) -> None:
        self.tables: list[str] = []
        self._before: Token | None = None

    def __enter__(self) -> Scope:
        self._before = _SCOPE.set(self)
        return self

    def __exit__(self, *_) -> None:
        _SCOPE.reset(self._before)

    def clear(self, spark: SparkSession, shuffles: bool = True) -> None:
        """Delete the scope's tables, and the shuffle files of what is no longer used; results that still read them must have been saved."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        gone, self.tables = self.tables, []
        for table in gone:
            path = jvm.org.apache.hadoop.fs.Path(table)
            path.getFileSystem(conf).delete(path, True)
        if gone and shuffles:
            gc.collect()
            jvm.System.gc()  # shuffle files go when what made them is collected


def finished(df_of: Callable[[], DataFrame], tag: str, shuffles: bool = True) -> DataFrame:
    """What df_of() gives as a written table; the tables that it made on the way are deleted."""
    with Scope() as own:
        df = df_of()
        path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(path)
    if (scope := _SCOPE.get()) is not None:
        scope.tables.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    del df
    own.clear(out.sparkSession, shuffles)
    return out


_SCOPE: ContextVar[Scope | None] = ContextVar("marquee_tables", default=None)


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if (scope := _SCOPE.get()) is not None:
        scope.tables.append(path)
    return path


def settled(df: DataFrame, tag: str) -> DataFrame:
    """An aggregate to be joined back to its rows, as a written table.

    Otherwise the aggregate and the join share a stage, which Spark can't split where one key
    holds many rows.
    """
    return written(df, tag)


def written(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder.

    Readers depend on files instead of on the tasks that made the rows, so a lost executor
    never repeats them, and several readers never recompute them. Values of the column `by` get
    folders of their own.
    """
    path = fresh_path(df.sparkSession, tag)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
