"""Hard negatives by coordinate pruning, exact.

Rows are sorted by length into buckets, each with its sorted coordinate lists. For an anchor, a
bucket and the least score that can still count, the coordinates on which the anchor is largest
(its focus) allow only ranges of values; rows within all ranges, taken from the lists, are
candidates, and their inner products are computed as whole numbers. The least score rises while
a task goes through its buckets from the longest rows on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import fresh_path, written

#: Rows a bucket (a place in a list takes two bytes), anchors a pass, and anchors whose scores are held at once.
BUCKET_ROWS, PASS_ANCHORS, CHUNK = 16_384, 32_768, 128
#: Coordinates that prune, and the share of a bucket up to which candidates are taken from lists.
FOCUS, SPARSE = 3, 0.25
#: Vectors of this length (after scaling) would need scores of more than 48 bits.
MOST_LENGTH = 1 << 24
_NEVER, _EVER = np.int64(-(1 << 62)), np.int64(1 << 50)
_BUCKETS = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("dim", pa.int32()), ("length", pa.float64()), ("wide", pa.bool_()), ("ids", pa.binary()), ("labels", pa.binary()), ("anchors", pa.binary()), ("values", pa.binary()), ("lists", pa.binary())])
BUCKET_SCHEMA = "part int, seq int, dim int, length double, wide boolean, ids binary, labels binary, anchors binary, values binary, lists binary"


def usable(rows: DataFrame, scale: int) -> DataFrame:
    """Rows (vec_id, label, anchor, q, length) that take part, q being floor(scale * x)."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(good)
    q = whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce("anchor", F.lit(False)).alias("anchor"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("q"))
    return q.withColumn("length", F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x)))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as buckets of one dimension. Within a bucket rows lie by label, then id."""
    from pyspark import TaskContext

    part, seq, held, rows, dim = TaskContext.get().partitionId(), 0, [], 0, -1

    def bucket() -> pa.RecordBatch:
        ids, labels, anchors, values = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((ids, labels))
        ids, labels, anchors, values = ids[order], labels[order], anchors[order], values[order].reshape(len(order), dim)
        length = float(np.sqrt((values.astype(float) ** 2).sum(axis=1).max()))
        wide = bool(values.size and np.abs(values).max() >= 1 << 15)
        lists = np.argsort(values.T, axis=1, kind="stable").astype("<u2")
        row = [part, seq, dim, length, wide, ids.astype("<i8").tobytes(), labels.astype("<i8").tobytes(), np.flatnonzero(anchors).astype("<i4").tobytes(), values.astype("<i4" if wide else "<i2").tobytes(), lists.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BUCKETS)], schema=_BUCKETS)

    for batch in batches:
        q = batch.column("q")
        offsets = q.offsets.to_numpy()
        values = q.values.to_numpy(zero_copy_only=False)
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "anchor")]
        dims = np.diff(offsets)
        at = 0
        while at < batch.num_rows:
            if dims[at] != dim or rows == BUCKET_ROWS:
                if rows:
                    yield bucket()
                    seq += 1
                held, rows, dim = [], 0, int(dims[at])
            other = np.flatnonzero(dims[at:] != dim)
            to = min(at + BUCKET_ROWS - rows, at + int(other[0]) if len(other) else batch.num_rows)
            held.append([c[at:to] for c in columns] + [values[offsets[at] : offsets[to]].reshape(to - at, dim)])
            rows, at = rows + to - at, to
    if rows:
        yield bucket()


def buckets(rows: DataFrame) -> tuple[DataFrame, float]:
    """The written table of buckets, and the length of the longest row."""
    whole = written(rows, "vectors")
    n, longest = whole.agg(F.count(F.lit(1)), F.max("length")).first()
    if (longest or 0.0) >= MOST_LENGTH:
        raise ValueError(f"scaled vectors of length {longest} are beyond the exact range, {MOST_LENGTH}")
    parts = max(whole.sparkSession.sparkContext.defaultParallelism, -(-n // (4 * BUCKET_ROWS)))
    order = [F.size("q"), F.col("length").desc(), F.col("vec_id"), F.hash("q")]
    ordered = whole.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return written(ordered.select("vec_id", "label", "anchor", F.transform("q", lambda x: x.cast("int")).alias("q")).mapInArrow(_pack, BUCKET_SCHEMA), "buckets"), longest or 0.0


def _opened(row: dict) -> tuple[np.ndarray, ...]:
    ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
    values = np.frombuffer(row["values"], "<i4" if row["wide"] else "<i2").reshape(len(ids), row["dim"])
    return ids, labels, values, np.frombuffer(row["lists"], "<u2").reshape(row["dim"], len(ids))


def _place(row: dict, at: np.ndarray) -> np.ndarray:
    """A number for each row of a bucket that no other row has."""
    return (np.int64(row["part"]) << 40) + (np.int64(row["seq"]) << 16) + at


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            at = np.frombuffer(row["anchors"], "<i4")
            if len(at):
                ids, labels, values, _ = _opened(row)
                raw = [v.astype("<i4").tobytes() for v in values[at]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["dim"], np.int32)), pa.array(_place(row, at)), pa.array(ids[at]), pa.array(labels[at]), pa.array(raw, pa.binary())], ["dim", "place", "anchor_id", "label", "q"])


def _ranges(q: np.ndarray, size: np.ndarray, focus: np.ndarray, least: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each anchor and focus coordinate the range of values that rows up to `length` with a score of `least` can have.

    With p and q at angles to the coordinate's axis, p lies within arccos(least / (|p| |q|)) of q, and
    so does its own angle to the axis. An empty range means that no row can reach the score.
    """
    reach = size * length
    need = np.where(reach > 0, least / np.where(reach > 0, reach, 1.0), np.where(least > 0, 2.0, -1.0))
    wide = np.arccos(np.clip(need, -1.0, 1.0))[:, None]
    own = np.arccos(np.clip(np.take_along_axis(q, focus, 1) / np.where(size > 0, size, 1.0)[:, None], -1.0, 1.0))
    low = np.floor(length * np.cos(np.minimum(np.pi, own + wide)) - 1e-6 * length) - 1
    high = np.ceil(length * np.cos(np.maximum(0.0, own - wide)) + 1e-6 * length) + 1
    low[need > 1 + 1e-9] = np.inf
    return low, high


class _Search:
    """The best `k` rows of each anchor and slot, a slot being a range of scores; same: of its label, or of others."""

    def __init__(self, q, ids, labels, places, low, high, k: int, same: bool, exact):
        self.q, self.labels, self.places, self.same, self.k = q.astype(exact), labels, places, same, k
        self.low, self.high = low, high  # anchors x slots
        self.size = np.sqrt((q.astype(float) ** 2).sum(axis=1))
        self.focus = np.argsort(-np.abs(q), axis=1, kind="stable")[:, : min(FOCUS, q.shape[1])]
        self.score = np.full((*low.shape, k), _NEVER)
        self.row = np.full((*low.shape, k), np.iinfo(np.int64).max)

    def _floor(self) -> np.ndarray:
        """Of each anchor and slot the least score that can still count."""
        return np.maximum(self.low, self.score[:, :, -1])

    def bucket(self, row: dict) -> None:
        ids, labels, values, lists = _opened(row)
        n = len(ids)
        floor = self._floor()
        open_slot = floor <= self.high
        least, most = np.where(open_slot, floor, _EVER).min(axis=1), np.where(open_slot, self.high, _NEVER).max(axis=1)
        live = np.flatnonzero(open_slot.any(axis=1))
        if row["dim"] and len(live):
            low, high = _ranges(self.q[live].astype(float), self.size[live], self.focus[live], least[live].astype(float), row["length"])
            reached = np.isfinite(low).all(axis=1)
            live, low, high = live[reached], low[reached], high[reached]
            first, last = np.zeros(low.shape, np.int64), np.full(low.shape, n)
            for c in np.unique(self.focus[live]).tolist():
                i, j = np.nonzero(self.focus[live] == c)
                column = values[lists[c], c]
                first[i, j], last[i, j] = np.searchsorted(column, low[i, j], "left"), np.searchsorted(column, high[i, j], "right")
            width = np.maximum(last - first, 0)
            best = width.argmin(axis=1)
            sparse = width[np.arange(len(live)), best] <= SPARSE * n
        else:
            sparse = np.zeros(len(live), bool)
        exact = values.astype(self.q.dtype)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(sparse).tolist():
            a, b = live[i], best[i]
            at = lists[self.focus[a, b], first[i, b] : last[i, b]].astype(np.int64)
            for j in range(low.shape[1]):  # the lists' ranges meet
                if j != b:
                    v = values[at, self.focus[a, j]]
                    at = at[(v >= low[i, j]) & (v <= high[i, j])]
            at = at[(labels[at] == self.labels[a]) == self.same]
            score = (exact[at] @ self.q[a]).astype(np.int64)
            good = (score >= least[a]) & (score <= most[a])
            found.append((np.full(int(good.sum()), a), at[good], score[good]))
        for a in self._dense(live[~sparse], labels):
            span = slice(0, n)
            if self.same:
                span = slice(np.searchsorted(labels, self.labels[a[0]], "left"), np.searchsorted(labels, self.labels[a[0]], "right"))
            scores = self.q[a] @ exact[span].T
            bound = least[a].astype(scores.dtype)
            if self.same and scores.shape[1] > self.k + 1:  # its own row may be one of them
                bound = np.maximum(bound, np.partition(scores, -self.k - 1, axis=1)[:, -self.k - 1])
            i, at = np.nonzero((scores >= bound[:, None]) & (scores <= most[a].astype(scores.dtype)[:, None]))
            if not self.same:
                other = labels[at] != self.labels[a[i]]
                i, at = i[other], at[other]
            found.append((a[i], at + span.start, scores[i, at].astype(np.int64)))
        if found:
            self._merge(ids, _place(row, np.arange(n)), *(np.concatenate(x) for x in zip(*found)))

    def _dense(self, live: np.ndarray, labels: np.ndarray) -> Iterator[np.ndarray]:
        """Anchors whose scores with all rows are computed at once; of one label, if only its rows count."""
        if not self.same:
            yield from (live[k : k + CHUNK] for k in range(0, len(live), CHUNK))
            return
        present = np.isin(self.labels[live], labels)
        live = live[present][np.argsort(self.labels[live[present]], kind="stable")]
        for group in np.split(live, np.flatnonzero(np.diff(self.labels[live])) + 1):
            yield from (group[k : k + CHUNK] for k in range(0, len(group), CHUNK))

    def _merge(self, ids: np.ndarray, places: np.ndarray, anchor: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
        """Take the first k of each slot from what was found and what was known."""
        if self.same:
            other = places[at] != self.places[anchor]
            anchor, at, score = anchor[other], at[other], score[other]
        order = np.lexsort((ids[at], -score, anchor))
        anchor, at, score = anchor[order], at[order], score[order]
        own = np.unique(anchor)
        if not len(own):
            return
        begin, end = np.searchsorted(anchor, own), np.searchsorted(anchor, own, "right")
        for slot in range(self.low.shape[1]):
            low, high = self.low[own, slot], self.high[own, slot]
            start = begin.copy()
            for g in np.flatnonzero(score[begin] > high).tolist():  # past the scores above the slot
                start[g] += np.searchsorted(-score[begin[g] : end[g]], -high[g])
            take = start[:, None] + np.arange(self.k)
            good = take < end[:, None]
            take = np.minimum(take, len(score) - 1)
            good &= score[take] >= low[:, None]
            new_score, new_row = np.where(good, score[take], _NEVER), np.where(good, ids[at[take]], np.iinfo(np.int64).max)
            both, rows = np.concatenate([self.score[own, slot], new_score], axis=1), np.concatenate([self.row[own, slot], new_row], axis=1)
            first = np.lexsort((rows, -both), axis=-1)[:, : self.k]
            self.score[own, slot], self.row[own, slot] = np.take_along_axis(both, first, 1), np.take_along_axis(rows, first, 1)


def _pass(shared, k: int, same: bool, exact: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, q, ids, labels, places, low, high = shared.value
        search = _Search(q, ids, labels, places, low, high, k, same, exact)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["dim"] == dim:
                    search.bucket(row)
        a, slot, n = np.nonzero(search.score > _NEVER)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(search.row[a, slot, n]), pa.array(search.score[a, slot, n])], ["anchor", "slot", "row", "score"])

    return run


def _best(table: DataFrame, block: tuple, k: int, same: bool, exact: str, tag: str) -> DataFrame:
    """Rows (anchor, slot, row, score, rank) of a pass over all buckets; each task gives at most k rows a slot."""
    shared = table.sparkSession.sparkContext.broadcast(block)
    parts = table.mapInArrow(_pass(shared, k, same, exact), "anchor int, slot int, row long, score long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "row")
    out = written(parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), tag)
    shared.destroy()
    return out


def _blocks(anchors: DataFrame, most: int) -> Iterator[tuple]:
    """Anchors in blocks of one dimension, at most `most` each."""
    held: list = []
    for row in anchors.toLocalIterator(prefetchPartitions=False):
        if held and (len(held) == most or row.dim != held[0].dim):
            yield _block(held)
            held = []
        held.append(row)
    if held:
        yield _block(held)


def _block(rows: list) -> tuple:
    dim = rows[0].dim
    q = np.frombuffer(b"".join(bytes(r.q) for r in rows), "<i4").reshape(len(rows), dim)
    return dim, q, *(np.array([r[c] for r in rows], np.int64) for c in ("anchor_id", "label", "place"))


def hard_negatives(embeddings: DataFrame, scale: int = 256, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, pass_anchors: int = PASS_ANCHORS) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `embeddings` has vec_id, label (a whole number), embedding and anchor (whether the row is one).
    Components count as floor(scale * x), scores are inner products of these, and ties go to the
    smaller vec_id. An anchor's positives are its best other rows of its label; a positive's
    negatives are the best rows of other labels with a score from least to most percent of the
    positive's. All rows are searched; the result is exact.

    Rows without a vec_id, label or vector, or with a null or non-finite component, take no part.
    Vectors of different dimension never meet; those without components score 0. Rows that repeat
    a vec_id are rows of their own. Other columns are ignored; an empty table gives no rows. A scaled
    vector longer than 2 ** 24 is an error, as scores would leave the exact range.

    Anchors come in blocks of at most `pass_anchors` (some 15 MB at 64 components), each with two passes over the
    buckets; only a block and its best rows are on the driver or broadcast at a time.
    """
    spark = embeddings.sparkSession
    table, longest = buckets(usable(embeddings, scale))
    exact = "f4" if longest * longest < 1 << 24 else "f8"  # all partial sums are whole numbers that fit
    anchors = written(table.mapInArrow(_anchors, "dim int, place long, anchor_id long, label long, q binary"), "anchors").orderBy("dim", "place")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    path = fresh_path(spark, "hard-negatives")
    spark.createDataFrame([], schema).write.parquet(path)
    for dim, q, ids, labels, places in _blocks(anchors, pass_anchors):
        any_score = np.full((len(ids), 1), _NEVER + 1), np.full((len(ids), 1), _EVER)
        best = _best(table, (dim, q, ids, labels, places, *any_score), positives, True, exact, "positives")
        low, high = np.ones((len(ids), positives), np.int64), np.zeros((len(ids), positives), np.int64)  # no score is in an empty slot
        for r in best.toLocalIterator():
            low[r.anchor, r.rank - 1], high[r.anchor, r.rank - 1] = -(-least * r.score // 100), most * r.score // 100
        found = _best(table, (dim, q, ids, labels, places, low, high), negatives, False, exact, "negatives")
        names = spark.createDataFrame(pa.table({"anchor": np.arange(len(ids), dtype=np.int32), "anchor_id": ids}))
        of = best.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("row").alias("positive_id"), F.col("score").alias("positive_score"))
        joined = found.join(of, ["anchor", "slot"]).join(F.broadcast(names), "anchor")  # a block's anchors
        joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("row").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
