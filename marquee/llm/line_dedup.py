"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

Each text is a sequence of line ids. Places whose line occurs elsewhere get ranks by their first
1, 2, 4, ... lines, until every suffix is unique or has ended: that order is the suffix array of
all texts. Neighbours in it get the length of their longest common prefix from the ranks of all
depths. Places between two lower values form an interval: a run of lines that repeats. A run is
maximal where the lines before it differ; later copies are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import dealt
from .store import finished, settled, written
from .text import pieces, spans_of, utf8

#: A repeated run counts with this many lines, or if one line alone has this many words.
MIN_LINES, LONG_LINE_WORDS = 2, 50
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, at, size, n1, n2, words): lines that aren't blank, numbered from 0 of size, with their hashes."""
    for batch in pieces(batches):
        data, offsets = utf8(batch.column("text"))
        raw = data.tobytes()
        which, at, digests, sizes, totals = [], [], [], [], []
        words, _, _ = spans_of(~_BLANK[data], offsets)
        for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            n, place = 0, a
            for line in raw[a:b].split(b"\n"):
                if stripped := line.strip():
                    which.append(d)
                    at.append(n)
                    digests.append(xxhash.xxh3_128_digest(stripped))
                    sizes.append((place, place + len(line)))
                    n += 1
                place += len(line) + 1
            totals += [n] * n
        names = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        edges = np.array(sizes, np.int64).reshape(-1, 2)
        many = np.searchsorted(words, edges[:, 1]) - np.searchsorted(words, edges[:, 0])
        rows = pa.array(np.array(which, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("key").take(rows), pa.array(np.array(at, np.int64)), pa.array(np.array(totals, np.int64)), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(many.astype(np.int64))], ["doc_id", "key", "at", "size", "n1", "n2", "words"])


PLACE = ["doc_id", "key", "at"]


#: Places of the suffix array that are read in a row to tell its intervals apart.
_BLOCK = 1 << 14


def _places(lines: DataFrame) -> DataFrame:
    """Places whose line occurs elsewhere, with its rank among all lines and the line before it."""
    classes = lines.groupBy("n1", "n2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranked = written(dealt(classes, ["n1", "n2"], "line-classes", "n").select("n1", "n2", F.col("before").alias("line")), "line-ranks")
    places = lines.join(ranked, ["n1", "n2"]).drop("n1", "n2").dropDuplicates(["key", "at"])
    before = F.lag(F.struct("at", "line")).over(Window.partitionBy("key").orderBy("at"))
    places = places.withColumn("b", before).withColumn("left", F.when(F.col("b.at") == F.col("at") - 1, F.col("b.line"))).drop("b")
    return written(places.withColumns({"rank": F.col("line"), "open": F.lit(True), "fresh": F.lit(True)}), "places")


def _doubled(every: DataFrame, depth: int) -> DataFrame:
    """The places with ranks by twice as many lines; those that are unique or have ended stay as they are."""
    last, about = (1 << 63) - 1, ["doc_id", "key", "at", "size", "words", "line", "left"]
    ahead = every.select("key", (F.col("at") - depth).alias("at"), F.col("rank").alias("next"))
    lone = F.col("next").isNull() & (F.col("at") + depth < F.col("size"))  # the line there is the only one of its kind, and sorts last
    second = F.when(lone, F.lit(last)).otherwise(F.coalesce("next", F.lit(-1)))
    pairs = every.where("open").join(ahead, ["key", "at"], "left").select(*about, "rank", second.alias("s1"), F.when(lone, F.col("key")).otherwise(F.lit(0)).alias("s2"), F.when(lone, F.col("at")).otherwise(F.lit(0)).alias("s3"))
    pairs = written(pairs, "suffix-pairs")
    order = ["rank", "s1", "s2", "s3"]
    classes = dealt(pairs.groupBy(*order).agg(F.count(F.lit(1)).alias("n")), order, "run-classes", "n")
    named = classes.join(classes.groupBy("rank").agg(F.min("before").alias("base")), "rank").select(*order, "n", (F.col("rank") + F.col("before") - F.col("base")).alias("new"))
    now = pairs.join(named, order).select(*about, F.col("new").alias("rank"), ((F.col("n") > 1) & (F.col("s1") >= 0)).alias("open"), F.lit(True).alias("fresh"))
    return now.unionByName(every.where("NOT open").withColumn("fresh", F.lit(False)))


def suffix_array(lines: DataFrame) -> DataFrame:
    """Rows (doc_id, key, at, words, line, pos, lcp, maximal) of all places whose line occurs elsewhere.

    pos is the place in the order of all suffixes, which end with their text; suffixes that are
    equal to the end are ordered by text. lcp is the number of lines that it shares with the
    suffix before it, and maximal says that the lines before these two differ.
    """
    every, depth = _places(lines), 1
    levels = [(1, every.select("key", "at", "rank"))]
    while every.where("open").head(1):
        every = finished(lambda now=every, at=depth: _doubled(now, at), "suffixes", shuffles=False)
        depth *= 2
        levels.append((depth, every.where("fresh").select("key", "at", "rank")))
    array = written(dealt(every.drop("open", "fresh"), ["rank", "key", "at"], "suffix-order").withColumnRenamed("before", "pos"), "suffix-array")
    return _with_common(array, levels)


def _with_common(array: DataFrame, levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """Adds the longest common prefix of each suffix and the one before it.

    Where the lines before two neighbours are the same, the value is one less than that of the
    place before in the text; only the others are counted out from the ranks of each depth.
    """
    other = array.select((F.col("pos") + 1).alias("pos"), *[F.col(c).alias(f"o_{c}") for c in ("key", "at", "size", "line", "left")])
    pairs = array.join(other, "pos", "left").withColumn("same", F.coalesce(F.col("line") == F.col("o_line"), F.lit(False)))
    pairs = written(pairs.withColumn("maximal", ~(F.col("same") & F.coalesce(F.col("left") == F.col("o_left"), F.lit(False)))), "neighbours")
    least = F.least(F.col("size") - F.col("at"), F.col("o_size") - F.col("o_at"))
    counted = pairs.where("maximal AND same").select("pos", "key", "at", "o_key", "o_at", least.alias("most"), F.lit(0).cast("long").alias("n"))
    for k, (depth, ranks) in reversed(list(enumerate(levels))):
        mine = ranks.select("key", F.col("at").alias("x"), F.col("rank").alias("mine"))
        theirs = ranks.select(F.col("key").alias("o_key"), F.col("at").alias("y"), F.col("rank").alias("theirs"))
        counted = counted.withColumns({"x": F.col("at") + F.col("n"), "y": F.col("o_at") + F.col("n")}).join(mine, ["key", "x"], "left").join(theirs, ["o_key", "y"], "left")
        more = F.when(F.col("mine") == F.col("theirs"), F.lit(depth)).otherwise(F.lit(0))
        counted = counted.select("pos", "key", "at", "o_key", "o_at", "most", (F.col("n") + more).alias("n"))
        if k % 3 == 0:  # plans of some joins each
            counted = written(counted, "common")
    known = pairs.join(counted.select("pos", F.least("n", "most").alias("n")), "pos", "left")
    known = known.withColumn("start", F.when(F.col("maximal"), F.struct("at", F.coalesce("n", F.lit(0)).alias("n"))))
    start = F.last("start", ignorenulls=True).over(Window.partitionBy("key").orderBy("at"))
    known = known.withColumn("s", start).withColumn("lcp", F.col("s.n") - (F.col("at") - F.col("s.at")))
    return written(known.select("doc_id", "key", "at", "words", "line", "pos", "lcp", "maximal"), "common-prefixes")


def _later(rows: DataFrame, by: str) -> DataFrame:
    """The places (key, at) of each interval but the first in the texts' order."""
    first = settled(rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*PLACE)).alias("first")).where("n > 1"), "first-copies")
    return rows.join(first, by).where(F.struct(*PLACE) > F.col("first")).select("key", "at")


def later_copies(array: DataFrame, least: int) -> DataFrame:
    """The places (key, at) of the suffix array whose first `least` lines also start at an earlier place.

    An interval is the places from one with a shorter common prefix to the next such one. Its
    number comes from blocks of places and the last such one of each block.
    """
    rows = array.select(*PLACE, "pos", F.when(F.col("lcp") < least, F.col("pos")).alias("start"), F.floor(F.col("pos") / _BLOCK).alias("block"))
    ends = rows.groupBy("block").agg(F.max("start").alias("end"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each 16,384 places: Spark broadcasts it up to its own bound
    ends = ends.select("block", F.max("end").over(before).alias("carried"))
    own = F.max("start").over(Window.partitionBy("block").orderBy("pos"))
    rows = rows.withColumn("own", own).join(ends, "block").withColumn("interval", F.coalesce("own", "carried"))
    return _later(written(rows.select(*PLACE, "interval"), "intervals"), "interval")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        texts, sizes, removed, runs = [], [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
            gone, kept, n = set(gone or ()), [], 0
            for line in text.split("\n"):
                if line.strip(" \t\r\x0b\x0c"):
                    if n not in gone:
                        kept.append(line)
                    n += 1
                else:
                    kept.append(line)
            texts.append("\n".join(kept) if gone else text)
            sizes.append(n)
            removed.append(len(gone))
            runs.append(sum(g - 1 not in gone for g in gone))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "gone"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], [*(c for c in batch.schema.names if c != "gone"), "kept_text", "n_lines", "n_removed", "n_runs"])


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_LINE_WORDS, keep: Sequence[str] = ()) -> DataFrame:
    """Rows (doc_id, kept_text, n_lines, n_removed, n_runs), one for each row of `docs`.

    Lines are compared without white space at their ends; blank ones don't count and stay. A
    run of min_lines lines, or a line of long_words words, goes where the same run starts at an
    earlier place, by doc_id (null first) and line. Overlapping copies join to maximal runs.
    Of rows with one doc_id, the order is that of a hash of the text; equal rows are one and
    keep the same lines. A null text is empty. Other columns are ignored, but those in `keep`
    come along with their row; an empty table gives no rows. A hot line is pre-aggregated by each task, and joins back where Spark can split.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *keep).withColumn("key", F.xxhash64("doc_id", "text"))
    lines = keyed.select("doc_id", "text", "key").mapInArrow(_lines, f"doc_id {kind}, key long, at long, size long, n1 long, n2 long, words long")
    gone = finished(lambda: _gone(lines, min_lines, long_words), "lines-gone")
    cut = keyed.join(gone.hint("merge"), "key", "left").select("doc_id", "text", *keep, "gone")
    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return cut.mapInArrow(_cut, f"doc_id {kind}, text string, {kinds}kept_text string, n_lines long, n_removed long, n_runs long").drop("text")


def _gone(lines: DataFrame, min_lines: int, long_words: int) -> DataFrame:
    """Rows (key, gone): the places of the lines that go."""
    array = suffix_array(lines)
    gone = _later(array.where(F.col("words") >= long_words), "line")  # the intervals of depth 1 are those of equal lines
    gone = gone.unionByName(later_copies(array, min_lines).select("key", F.explode(F.sequence("at", F.col("at") + min_lines - 1)).alias("at")))
    return gone.groupBy("key").agg(F.collect_set("at").alias("gone"))
