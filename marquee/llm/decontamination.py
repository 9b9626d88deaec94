"""Benchmark decontamination with an FM-index per shard of the training texts.

A shard is what a task holds of its texts at a time. Words that occur in no test phrase end
runs; runs as long as the shortest phrase make up the shard's index. Test phrases are searched
backwards in it, their occurrences are located, and their spans merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .passes import in_passes
from .text import flat_index, hash_spans, mix, pieces, spans_of, utf8

WINDOW = 13
#: Text bytes of a shard, and of the test items that one pass over the texts looks for.
SHARD_BYTES, BLOCK_BYTES = 1 << 20, 4 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of all words in lower case, and the number of words before each offset."""
    low = _LOWER[data]
    starts, ends, before = spans_of(_WORD[low], offsets)
    return hash_spans(low, starts, ends), starts, ends, before


def _by_name(item: str | None) -> tuple[bool, str]:
    return item is None, item or ""


class Phrases:
    """A block of test items: its vocabulary, its distinct phrases, and the items of each phrase."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.names = sorted({i for i, _ in items}, key=_by_name)
        number = {name: k for k, name in enumerate(self.names)}
        column = pa.array([t for _, t in items], pa.large_string())
        hashes, _, _, before = words_of(*utf8(column))
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        ids = ids.astype(np.int32) + 1
        n = np.diff(before)
        many = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
        of = np.repeat(np.arange(len(items)), many)
        starts = flat_index(before[:-1], many)
        sizes = np.minimum(n, window)[of]
        rows = np.zeros((len(starts), window), np.int32)  # phrases end at the last column
        for k in range(1, window + 1):
            has = sizes >= k
            rows[has, window - k] = ids[(starts + sizes - k)[has]]
        packed = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.itemsize * window))).reshape(-1)
        _, first, phrase = np.unique(packed, return_index=True, return_inverse=True)
        self.phrases, self.sizes = rows[first], sizes[first]
        self.shortest = int(self.sizes.min()) if len(first) else 0
        item = np.array([number[i] for i, _ in items], np.int64)[of]
        pairs = np.unique(np.stack([phrase.reshape(-1), item], 1), axis=0) if len(of) else np.zeros((0, 2), np.int64)
        self.item_sizes = np.bincount(pairs[:, 0], minlength=len(first)).astype(np.int64)
        self.item_starts = np.cumsum(self.item_sizes) - self.item_sizes
        self.items = pairs[:, 1]

    def search(self, hashes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, phrase) of all occurrences in a shard; texts are bounded by `before`."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not self.shortest or not len(hashes):
            return none
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == hashes
        starts, ends, _ = spans_of(known, before)
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return none
        words = flat_index(starts, ends - starts)
        index = FMIndex(at[words] + 1, np.concatenate([[0], np.cumsum(ends - starts)]), len(self.vocabulary) + 1)
        low, high = index.ranges(self.phrases, self.sizes)
        hit = np.flatnonzero(low < high)
        rows = flat_index(low[hit], high[hit] - low[hit])
        return words[index.locate(rows)], np.repeat(hit, high[hit] - low[hit])


def _scan(shared, window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Phrases = shared.value
        for batch in pieces(batches, limit=SHARD_BYTES):
            data, offsets = utf8(batch.column("text"))
            hashes, starts, ends, before = words_of(data, offsets)
            at, phrase = block.search(hashes, before)
            edge = np.zeros(len(hashes) + 1, np.int32)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + block.sizes[phrase], -1)
            hit = np.cumsum(edge[:-1]) > 0
            which = np.searchsorted(before, at, "right") - 1
            pairs = np.unique(np.stack([which, phrase], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
            item = block.items[flat_index(block.item_starts[pairs[:, 1]], block.item_sizes[pairs[:, 1]])]
            pairs = np.unique(np.stack([np.repeat(pairs[:, 0], block.item_sizes[pairs[:, 1]]), item], 1), axis=0) if len(pairs) else pairs
            items: list[list[str | None]] = [[] for _ in range(batch.num_rows)]
            for d, i in pairs.tolist():
                items[d].append(block.names[i])
            first, last, of = spans_of(hit, before)
            spans = [[{"word": a, "end_word": b, "from": c, "to": d} for a, b, c, d in zip(*(x.tolist() for x in (first[p:q] - w, last[p:q] - w, starts[first[p:q]] - o, ends[last[p:q] - 1] - o)))] for p, q, w, o in zip(of[:-1].tolist(), of[1:].tolist(), before[:-1].tolist(), offsets[:-1].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(before)), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "spans", "item_ids"])

    return scan


_SPANS = pa.list_(pa.struct([(c, pa.int64()) for c in ("word", "end_word", "from", "to")]))
_SPANS_SQL = "array<struct<word: long, end_word: long, from: long, to: long>>"


def _merged(spans: Column) -> Column:
    """Spans in order, with those that overlap or touch as one."""
    empty = F.array().cast(_SPANS_SQL)

    def add(known: Column, s: Column) -> Column:
        last = F.try_element_at(known, F.lit(-1))
        longer = F.struct(last["word"].alias("word"), s["end_word"].alias("end_word"), last["from"].alias("from"), s["to"].alias("to"))
        joined = F.when(s["end_word"] > last["end_word"], F.concat(F.slice(known, F.lit(1), F.size(known) - 1), F.array(longer))).otherwise(known)
        return F.when((F.size(known) > 0) & (s["word"] <= last["end_word"]), joined).otherwise(F.concat(known, F.array(s)))

    return F.aggregate(F.array_sort(spans), empty, add)


def _blocks(benchmark: DataFrame, block_bytes: int, unnamed: bool) -> Iterator[list[tuple[str | None, str]]]:
    """The test items in blocks of bounded size; a partition at a time comes to the driver."""
    held, size, any_block = [], 0, False
    rows = benchmark.select(F.col("item_id").cast("string"), "text").where("text IS NOT NULL")
    rows = rows if unnamed else rows.where("item_id IS NOT NULL")
    for item, text in rows.toLocalIterator():
        held.append((item, text))
        size += len(text.encode())
        if size >= block_bytes:
            yield held
            held, size, any_block = [], 0, True
    if held or not any_block:
        yield held


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, unnamed: bool = False) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, item_ids, spans, contaminated), one for each row of `docs`.

    The test phrases are all runs of `window` words of an item, or the whole of a shorter one.
    spans are the merged runs of hit words, as words and as bytes of the text. Items come to the
    tasks in blocks of bounded size, each in one pass over the texts. With one block nothing is
    shuffled; with more, only what they find is. Null
    texts have no words. Items without text or words are left out; repeated ids are one item.
    With `unnamed`, items without id hit as others do, and all of them are one null in item_ids,
    which n_items counts; otherwise they are left out. Other columns are ignored. Empty tables give no rows, or no hits.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"n_words long, spans {_SPANS_SQL}, item_ids array<string>"
    made = (Phrases(items, window) for items in _blocks(benchmark, block_bytes, unnamed))
    merged = [F.max("n_words").alias("n_words"), _merged(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids")]
    rows = in_passes(docs, made, lambda shared: _scan(shared, window), out, "size(spans) > 0", merged)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["word"])
    rows = rows.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "spans")
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
