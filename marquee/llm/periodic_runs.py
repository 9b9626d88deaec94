"""Periodic runs of words, by string synchronising sets at dyadic scales.

A run is a stretch of words with smallest period q and at least max(6, 4 q) words which no
neighbouring word extends. At scale t, a power of two, positions are selected by the hashes of
the t-word strings about them alone, so that equal contexts of 2 t words are selected alike.
Every run with t <= q < 2 t holds a selected position within its first t words, and that
position's context comes again q words later and not before. Neighbours of equal context are
therefore pairs that propose every such period. Positions within regions of periods up to
t / 4, which are known from smaller scales, are left out, so that a scale selects few positions;
the regions themselves supply their small periods, and repeated single words are found directly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .text import flat_index, mix, pieces, spans_of, utf8

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
RUN = "struct<start: bigint, length: bigint, period: bigint>"
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _doubled(hashes: np.ndarray, t: int) -> np.ndarray:
    """Hashes of strings of 2 t words from those of t words."""
    return mix(hashes[:-t] * _ODD + mix(hashes[t:] ^ _ODD))


def _least(keys: np.ndarray, t: int) -> np.ndarray:
    """The least of each t + 1 neighbouring keys; t is a power of two."""
    found, n = keys, 1
    while n < t:
        found = np.minimum(found[:-n], found[n:])
        n *= 2
    return np.minimum(found[:-1], found[1:])


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    steps = np.diff(np.concatenate([[False], equal, [False]]).view(np.int8))
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def _extended(words: np.ndarray, start: int, end: int, period: int) -> tuple[int, int]:
    """The longest stretch with the period about words[start:end], which has it."""
    step = 64
    while start > 0:
        a = max(0, start - step)
        unequal = np.flatnonzero(words[a:start] != words[a + period : start + period])
        if len(unequal):
            start = a + int(unequal[-1]) + 1
            break
        start, step = a, 2 * step
    step = 64
    while end < len(words):
        b = min(len(words), end + step)
        unequal = np.flatnonzero(words[end:b] != words[end - period : b - period])
        if len(unequal):
            end += int(unequal[0])
            break
        end, step = b, 2 * step
    return start, end


def _pairs(contexts: np.ndarray, at: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions, and distances to the next of equal context, for distances from t to 2 t - 1."""
    order = np.argsort(contexts, kind="stable")
    found, same = at[order], contexts[order][1:] == contexts[order][:-1]
    distance = found[1:] - found[:-1]
    good = same & (distance >= t) & (distance < 2 * t)
    return found[:-1][good], distance[good]


def runs_of(words: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run in `words`, in which no run has more than `longest` words."""
    known: dict[tuple[int, int], int] = {}
    starts, ends = _stretches(words[1:] == words[:-1])
    regions = [(a, b + 1, 1) for a, b in zip(starts.tolist(), ends.tolist()) if b + 1 - a >= LEAST_TIMES]
    for a, b, _ in regions:
        if b - a >= LEAST_WORDS:
            known[a, b] = 1
    t, hashes = 1, mix(words.astype(np.uint64))
    while 2 * t * LEAST_TIMES <= longest and len(hashes) > 4 * t:
        hashes, t = _doubled(hashes, t), 2 * t
        keys = hashes.copy()
        for a, b, period in regions:
            if LEAST_TIMES * period <= t <= b - a:
                keys[a : b - t + 1] = _NONE
        least = _least(keys, t)
        n = len(least)
        at = np.flatnonzero((least != _NONE) & ((least == keys[:n]) | (least == keys[t : n + t])))
        where, distance = _pairs(mix(hashes[at] * _ODD + mix(hashes[at + t] ^ _ODD)), at, t)
        order = np.lexsort((where, distance))
        own, covered = 0, 0
        for i, period in zip(where[order].tolist(), distance[order].tolist()):
            if period == own and i + period + 2 * t <= covered:
                continue  # it lies in the stretch just found
            if not np.array_equal(words[i : i + 2 * t], words[i + period : i + period + 2 * t]):
                continue  # hashes that are equal by chance
            start, end = _extended(words, i, i + period + 2 * t, period)
            own, covered = period, end
            if end - start >= max(LEAST_WORDS, LEAST_TIMES * period) and (start, end) not in known:
                known[start, end] = period
                regions.append((start, end, period))
    return sorted((a, b, q) for (a, b), q in known.items())


def _found(words: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of a batch of documents, as places in `words`. Documents of like length are searched together."""
    lengths = np.diff(offsets)
    size = np.frexp(lengths.astype(float))[1]
    out = []
    for k in np.unique(size[lengths >= LEAST_WORDS]).tolist():
        docs = np.flatnonzero((size == k) & (lengths >= LEAST_WORDS))
        n = lengths[docs]
        first = np.cumsum(n + 1) - (n + 1)
        joined = np.empty(int((n + 1).sum()), np.int64)
        joined[flat_index(first, n)] = words[flat_index(offsets[docs], n)]
        joined[first + n] = -1 - np.arange(len(docs))  # each end is a word of its own, so no run crosses it
        runs = runs_of(joined, int(n.max()))
        if runs:
            starts = np.array([a for a, _, _ in runs])
            shift = (offsets[docs] - first)[np.searchsorted(first, starts, "right") - 1].tolist()
            out += [(a + s, b + s, q) for (a, b, q), s in zip(runs, shift)]
    return sorted(out)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        data, offsets = utf8(batch.column("text"))
        member = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
        begins, ends, at = spans_of(member, offsets)
        starts = np.append(0, np.cumsum(ends - begins))
        words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data[member].tobytes()))
        runs = _found(words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), at)
        kept = np.ones(len(words), bool)
        for a, b, q in runs:
            kept[a + q : b] = False
        kept_before = np.append(0, np.cumsum(kept))
        lists = pa.ListArray.from_arrays(pa.array(kept_before[at], pa.int32()), words.filter(pa.array(kept)))
        a, b, q = (np.array(x, np.int64) for x in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 3
        doc = np.searchsorted(at, a, "right") - 1
        columns = pa.StructArray.from_arrays([pa.array(a - at[doc]), pa.array(b - a), pa.array(q)], ["start", "length", "period"])
        found = pa.ListArray.from_arrays(pa.array(np.searchsorted(a, at), pa.int32()), columns)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), found, pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, runs, collapsed), one for each row of `docs` (doc_id, text).

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. `runs` has every run by start and then
    period; `collapsed` has the words that no run contains after its first period, joined by one
    space. A null or empty text has no words and no runs. Rows with a null or repeated doc_id
    each have a result of their own; other columns are ignored; an empty table gives no rows.
    Each text is searched whole: a task holds about a megabyte of texts, or one longer text with
    some 80 bytes a word. Nothing shuffles.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_batches, f"doc_id {kind}, n_words long, runs array<{RUN}>, collapsed string")
