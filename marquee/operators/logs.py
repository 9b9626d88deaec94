"""Error digests and tails of run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words by which a line counts as an error.
ERROR_MARKS = ("ERROR", "CRITICAL", "Traceback")


def is_error(line: Column) -> Column:
    found = F.lit(False)
    for mark in ERROR_MARKS:
        found = found | F.contains(line, F.lit(mark))
    return found


def error_text(line: Column) -> Column:
    """What follows the last ERROR, else the line, without spaces around."""
    return F.trim(F.element_at(F.split(line, "ERROR"), -1))


def clean_text(line: Column) -> Column:
    """error_text without what a bracketed level leaves."""
    return F.trim(F.regexp_replace(error_text(line), r"^\]", ""))


def log_level(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, r"\[([A-Z]+)\]", 1), F.lit(""))


def error_digest(lines: DataFrame, most: int = 3, clean: bool = False) -> DataFrame:
    """Rows (file, position, message, first_line): the first distinct errors of each file."""
    message = clean_text(F.col("line")) if clean else error_text(F.col("line"))
    found = lines.where(is_error(F.col("line"))).groupBy("file", message.alias("message")).agg(F.min("line_no").alias("first_line"))
    order = Window.partitionBy("file").orderBy("first_line")
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)


def run_status(lines: DataFrame) -> DataFrame:
    """Rows (file, success, n_errors)."""
    return lines.groupBy("file").agg(F.sum(is_error(F.col("line")).cast("long")).alias("n_errors")).select("file", (F.col("n_errors") == 0).alias("success"), "n_errors")


def log_tail(lines: DataFrame, n: int = 100) -> DataFrame:
    """The last n lines of each file."""
    order = Window.partitionBy("file").orderBy(F.col("line_no").desc())
    return lines.withColumn("from_end", F.row_number().over(order)).where(F.col("from_end") <= n).drop("from_end")


def latest_file(lines: DataFrame) -> DataFrame:
    """The lines of the file modified last (ties: the last by name)."""
    newest = lines.groupBy("file").agg(F.max("modified").alias("modified")).agg(F.max_by("file", F.struct("modified", "file")).alias("file"))
    return lines.join(F.broadcast(newest), "file", "left_semi")
