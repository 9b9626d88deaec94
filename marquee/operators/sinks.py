"""Sinks: published lists, snapshots and change feeds, as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


RUNS = "run_id string, columns string"


def publish(new: DataFrame, served: DataFrame, old: DataFrame | None, path: str, run_id: str) -> None:
    """Write a whole snapshot of all lists under path/run_id=..., and then a row about the run.

    `new` has the lists of this run and `served` the (user_id, category) pairs that had
    candidates. A pair with candidates gets its new list, also if that is empty; one without
    keeps its old list. A run counts from its row in path/_runs on, also if all lists are empty.
    """
    rows = new
    if old is not None:
        kept = old.select(new.columns).join(served.select("user_id", "category").distinct(), ["user_id", "category"], "left_anti")
        rows = new.unionByName(kept)
    rows.write.mode("overwrite").partitionBy("category").parquet(f"{path}/run_id={run_id}")
    columns = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)
    new.sparkSession.createDataFrame([(run_id, columns)], RUNS).coalesce(1).write.mode("append").json(f"{path}/_runs")


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The latest snapshot: that with the greatest run_id. Other snapshots aren't read."""
    run = spark.read.schema(RUNS).json(f"{path}/_runs").orderBy(F.col("run_id").desc()).first()
    return spark.read.schema(run["columns"]).parquet(f"{path}/run_id={run.run_id}")


COMMITS = "bucket string, run_id string, columns string"
BUCKETS = 64


def _bucket(buckets: int) -> Column:
    """The folder of a list: its category, spelled in hexadecimal digits, and a hash of its user."""
    return F.concat_ws("-", F.lower(F.hex("category")), F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("string"))


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, which need not exist."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(at) if f.isDirectory()) if files.exists(at) else []


def latest_commit(spark: SparkSession, path: str) -> str | None:
    """The run whose lists are served: the greatest whose commit was completed."""
    done = spark._jvm.org.apache.hadoop.fs.Path
    files = done(path).getFileSystem(spark._jsc.hadoopConfiguration())
    runs = [f.removeprefix("run_id=") for f in _folders(spark, f"{path}/_commits") if files.exists(done(f"{path}/_commits/{f}/_SUCCESS"))]
    return max(runs, default=None)


def _pointers(spark: SparkSession, path: str, run_id: str | None) -> DataFrame:
    return spark.createDataFrame([], COMMITS) if run_id is None else spark.read.schema(COMMITS).parquet(f"{path}/_commits/run_id={run_id}")


def _commit(pointers: DataFrame, path: str, run_id: str) -> None:
    """Completed as a whole by the marker that Spark writes last; until then readers see the run before."""
    pointers.coalesce(1).write.mode("overwrite").parquet(f"{path}/_commits/run_id={run_id}")


def publish_buckets(new: DataFrame, served: DataFrame, path: str, run_id: str, buckets: int = BUCKETS) -> None:
    """Publish lists by rewriting only the buckets of (category, user) that the run served.

    As with publish(), a pair of `served` gets its new list, also an empty one, and others keep
    theirs. Files are never changed: a touched bucket is written anew under data/run_id=..., and the
    commit says for each bucket whose run's files count. A run that dies before its commit
    changes nothing for readers and can be repeated. Run ids rise; a run that finds another
    one's commit since it began fails.
    """
    spark = new.sparkSession
    base = latest_commit(spark, path)
    if base is not None and run_id <= base:
        raise ValueError(f"run {run_id} is not later than {base}, which is published")
    bucket = _bucket(buckets)
    pairs = served.select("user_id", "category").distinct()
    touched = pairs.select(bucket.alias("bucket")).distinct()  # at most `buckets` a category
    before = _pointers(spark, path, base)
    rows = new.join(pairs, ["user_id", "category"], "left_semi").withColumn("bucket", bucket)
    old = _read_buckets(spark, path, before.join(touched, "bucket", "left_semi"))
    if old is not None:
        rows = rows.unionByName(old.join(pairs, ["user_id", "category"], "left_anti").withColumn("bucket", bucket))
    out = f"{path}/data/run_id={run_id}"
    rows.repartition("bucket").sortWithinPartitions("bucket", "user_id").write.mode("overwrite").partitionBy("bucket").parquet(out)
    columns = ", ".join(f"`{c}` {kind}" for c, kind in rows.drop("bucket").dtypes)
    made = [f.removeprefix("bucket=") for f in _folders(spark, out)]  # buckets that became empty have none
    now = spark.createDataFrame([(b, run_id, columns) for b in made], COMMITS)
    stays = before.join(touched, "bucket", "left_anti").withColumn("columns", F.lit(columns))
    if latest_commit(spark, path) != base:
        raise RuntimeError(f"another run was published since {base}")
    _commit(stays.unionByName(now), path, run_id)


def _read_buckets(spark: SparkSession, path: str, pointers: DataFrame) -> DataFrame | None:
    found = pointers.collect()  # a row a bucket
    if not found:
        return None
    return spark.read.schema(found[0].columns).parquet(*[f"{path}/data/run_id={r.run_id}/bucket={r.bucket}" for r in found])


def read_buckets(spark: SparkSession, path: str, kind: str, run_id: str | None = None) -> DataFrame:
    """The lists now served, or those of an earlier run; `kind` is the schema that an empty result has."""
    found = _read_buckets(spark, path, _pointers(spark, path, run_id or latest_commit(spark, path)))
    return spark.createDataFrame([], kind) if found is None else found.select(*spark.createDataFrame([], kind).columns)


def expire_buckets(spark: SparkSession, path: str) -> int:
    """Delete bucket folders that the latest commit doesn't point to, and earlier commits; returns how many folders went."""
    last = latest_commit(spark, path)
    used = {(r.run_id, r.bucket) for r in _pointers(spark, path, last).collect()}
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [f"{path}/data/{run}/{b}" for run in _folders(spark, f"{path}/data") for b in _folders(spark, f"{path}/data/{run}") if (run.removeprefix("run_id="), b.removeprefix("bucket=")) not in used]
    gone += [f"{path}/_commits/{c}" for c in _folders(spark, f"{path}/_commits") if last is not None and c.removeprefix("run_id=") < last]
    for folder in gone:
        files.delete(place(folder), True)
    return len(gone)


def save_preferences(prefs: DataFrame, path: str, run_date: str) -> None:
    prefs.write.mode("overwrite").parquet(f"{path}/run_date={run_date}")


def read_preferences(spark: SparkSession, path: str, run_date: str | None = None) -> DataFrame:
    """The snapshot of a day, or of the last one: rows (user_id, facet, value, num, run_date)."""
    day = run_date or max(f.removeprefix("run_date=") for f in _folders(spark, path) if f.startswith("run_date="))
    return spark.read.parquet(f"{path}/run_date={day}").withColumn("run_date", F.lit(day))


def write_feed(rows: DataFrame, path: str) -> None:
    """A change feed or manifest, replaced whole."""
    rows.write.mode("overwrite").parquet(path)


def write_documents(docs: DataFrame, path: str) -> None:
    """Sidecar documents (target, doc), by target."""
    docs.write.mode("overwrite").parquet(path)
