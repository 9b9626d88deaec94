"""Vectorised helpers over Arrow batches of texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE_BYTES = 1 << 20
#: What this worker holds for the tasks of a stage: caches by version and name, and the stage's number.
HELD: dict[tuple[str, str], object] = {}
_STAGE: list[int] = []


def trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidy() -> None:
    """Give back what an earlier stage left in this worker, which Spark reuses for other operators."""
    from pyspark import TaskContext

    context = TaskContext.get()
    if context is None or _STAGE == [context.stageId()]:
        return
    HELD.clear()
    if _STAGE:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim()
    _STAGE[:] = [context.stageId()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and n + 1 offsets into them; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes of text, or of one longer row."""
    tidy()
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, before = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at, before = to, int(ends[to - 1])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), which spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LONGEST, _BLOCK = 512, 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """The base's powers and their inverses modulo 2 ** 64, for the places of a block."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(_BLOCK + 1, base, np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps, dtype=np.uint64))
    return _POWERS


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; spans are in order, apart and not empty.

    Sums of powers over a block give every span's polynomial by a difference; spans of more than
    512 bytes are hashed one by one.
    """
    n = len(starts)
    starts, lengths = starts.astype(np.int64), (ends - starts).astype(np.int64)
    out = np.zeros(n, np.uint64)
    power, inverse = _powers()
    many = np.minimum(lengths, _LONGEST)
    a = 0
    while a < n:
        base = int(starts[a])
        b = int(np.searchsorted(starts, base + _BLOCK - _LONGEST, "right"))
        at, to = starts[a:b] - base, starts[a:b] - base + many[a:b]
        block = data[base : base + int(to[-1])]
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(_BYTES[block] * power[: len(block)], out=sums[1:])
        out[a:b] = (sums[to] - sums[at]) * inverse[at]
        a = b
    out = mix(out + lengths.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    for k in np.flatnonzero(lengths > _LONGEST).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : starts[k] + lengths[k]].tobytes())
    return out


def spans_of(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True that don't cross the offsets: starts, ends, and runs before each offset."""
    n = len(member)
    begins = np.zeros(n + 1, bool)
    begins[:n] = member
    begins[1:n] &= ~member[:-1]
    inner = offsets[offsets < n]
    begins[inner] = member[inner]
    starts = np.flatnonzero(begins)
    last = np.zeros(n + 1, bool)
    last[1:] = member
    last[1:n] &= ~member[1:]
    inner = offsets[(offsets > 0) & (offsets <= n)]
    last[inner] = member[inner - 1]
    ends = np.flatnonzero(last)
    return starts, ends, np.searchsorted(starts, offsets)


def flat_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range in turn."""
    full = lengths > 0
    starts, lengths = starts[full].astype(np.int64), lengths[full].astype(np.int64)
    steps = np.ones(int(lengths.sum()), np.int64)
    if len(starts):
        steps[0] = starts[0]
        steps[np.cumsum(lengths[:-1])] = starts[1:] - (starts[:-1] + lengths[:-1]) + 1
    return np.cumsum(steps, out=steps)
