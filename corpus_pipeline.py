"""From raw documents to token ids: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the
last return the columns of documents. Each row has decisions of its own, whether its doc_id is
unique, repeated or null.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import decontamination, language_id, line_dedup, lsh_forest, sentencepiece_codec
from marquee.llm.queries import tokenizer_file
from marquee.llm.store import Scope, fresh_path, settled, written

#: Documents with a lower mean marginal of their language have none that is clear, and are rejected.
LEAST_SCORE = 0.35
#: Most bytes of an Arrow batch between Spark and Python: executors go through five operators,
#: and batches of up to 64 MB of whole texts would be held several times by each task.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


#: What tells rows apart for decisions on the text alone: equal rows have the same.
KEY = {"id": "doc_id", "key1": "xxhash64(text)", "key2": "xxhash64(7, text)"}


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the row's key as its doc_id, for operators that carry the id along and only read the text."""
    return docs.select(F.struct(*[F.expr(x).alias(k) for k, x in KEY.items()]).alias("doc_id"), "text")


#: The tables that this thread's last stage made on its way.
_LAST: ContextVar[Scope | None] = ContextVar("last_stage", default=None)


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with the session's Arrow batches bounded, and without the tables of the stage before.

    A stage's rows are made after the call, so its tables stay until the next stage is called in
    this thread: by then its rows have been written, as the next one's docs.
    """

    @functools.wraps(work)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = spark.conf.get(BATCH_SETTING).removesuffix("b")
        if not own.isdigit() or int(own) > BATCH_BYTES:
            spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
        if (before := _LAST.get()) is not None:
            before.clear(spark)
        with Scope() as made:
            rows = work(spark, docs, sf_dir)
        _LAST.set(made)
        return rows

    return bounded


def _row(docs: DataFrame) -> Column:
    """A whole row as one column, so that no column of documents can clash with those of a stage."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def _with(docs: DataFrame, found: DataFrame, decided: str) -> DataFrame:
    """The rows of docs that the stage keeps, by what it found on their keys."""
    gone = settled(found.where(f"NOT ({decided})").select("doc_id.*").distinct(), "gone")
    on = [F.col(f"g.{k}").eqNullSafe(F.col(f"d.{k}")) for k in KEY]
    keyed = docs.select(_row(docs), *[F.expr(x).alias(k) for k, x in KEY.items()])
    return keyed.alias("d").join(gone.alias("g"), on, "left_anti").select("row.*")


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, or with no clear language."""
    found = language_id.predict(_keyed(docs), language_id.learn(docs))
    return _with(docs, found, f"lang_pred != '{language_id.UNDETERMINED}' AND score >= {LEAST_SCORE}")


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of repeated line runs; a document goes if nothing but blank lines is left."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.col("text").isNull().alias("_no_text")).alias("others")
    cut = line_dedup.line_dedup(docs.select("doc_id", "text", others), keep=["others"]).where("n_removed = 0 OR n_removed < n_lines")
    text = F.when(~F.col("others")["_no_text"], F.col("kept_text"))
    own = {"doc_id": F.col("doc_id"), "text": text}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("n_removed") == 0, F.col("others.n_chars")).otherwise(F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return cut.select(*[own[c].alias(c) if c in own else F.col("others")[c].alias(c) for c in docs.columns])


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group, that with the smallest doc_id; a null one comes last.

    Rows are numbered, so that the texts of one id are apart and rows without an id take part.
    """
    rows = written(docs.select(_row(docs), "doc_id", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row_no")), "numbered")
    found = lsh_forest.near_dedup(rows.select(F.col("row_no").alias("doc_id"), "row.text")).select(F.col("doc_id").alias("row_no"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie", "row_no")
    kept = found.join(rows.select("row_no", "doc_id", "tie"), "row_no").groupBy("component_id").agg(F.min(order).alias("first")).select("first.row_no")
    gone = found.select("row_no").join(settled(kept, "kept"), "row_no", "left_anti")  # far fewer than stay
    return rows.join(settled(gone, "gone"), "row_no", "left_anti").select("row.*")


@_stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages, by the share of their words."""
    found = decontamination.contamination(_keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), unnamed=True)
    return _with(docs, found, "NOT contaminated")


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left."""
    return sentencepiece_codec.round_trip(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [("language ID", language), ("line dedup", lines), ("near dedup", near_copies), ("decontamination", decontaminated), ("sentencepiece", tokens)]
#: SQL can't express the learned, hashed and encoding stages; a brute-force version tests them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. What a stage wrote for itself is deleted once its rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = Scope()
    for _, stage in STAGES[:-1]:
        rows = stage(spark, docs, sf_dir)
        with Scope() as result:
            path = fresh_path(spark, "stage")
        rows.write.parquet(path)
        docs = spark.read.schema(rows.schema).parquet(path)
        before.clear(spark)
        before = result
    return STAGES[-1][1](spark, docs, sf_dir)
