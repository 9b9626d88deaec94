"""Encoding of whole texts through a cache of the chunks between safe boundaries.

A boundary is safe where a single space stands between two characters that are not white
space. Byte-level BPE starts a pre-token there, and no SentencePiece piece crosses it, so a
text's ids are its chunks' ids in a row, and every distinct chunk is encoded once a worker.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from .text import HELD, flat_index, hash_spans, mix

Encode = Callable[[list[str], np.ndarray], list]
#: Bytes whose characters may be white space beyond ASCII (C2: 85 and A0; E1, E2, E3: others).
_DOUBT = (0xC2, 0xE1, 0xE2, 0xE3)
_GROUP_BYTES = 1 << 20


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all chunks, and the number of chunks before each offset."""
    n = len(data)
    solid = (data > 32) & (data != 127)
    doubt = np.isin(data, _DOUBT)
    if doubt.any():
        solid &= ~doubt
        solid[1:] &= ~doubt[:-1]
        solid[2:] &= ~doubt[:-2]
    begins = np.zeros(n + 1, bool)
    if n > 2:
        begins[1 : n - 1] = (data[1:-1] == 32) & solid[:-2] & solid[2:]
    ends = offsets[1:]
    begins[np.maximum(ends - 1, 0)] = False  # the next text's first character says nothing
    begins[offsets[:-1][ends > offsets[:-1]]] = True
    begins[n] = False
    starts = np.flatnonzero(begins)
    return starts, np.searchsorted(starts, offsets)


@dataclass
class Flat:
    """Lists of values in a row."""

    values: np.ndarray
    lengths: np.ndarray


def worker_cache(version: str, name: str, make: Callable[[], object]) -> object:
    """This worker's object of a name for one version of a file or model, kept while tasks of one stage come."""
    if (version, name) not in HELD:
        HELD[version, name] = make()
    return HELD[version, name]


class ChunkCoder:
    """Maps chunks to values (arrays) by an open hash table in NumPy; bounded by `capacity`."""

    def __init__(self, encode: Encode, dtype=np.uint16, capacity: int = 2_000_000):
        self.encode, self.dtype, self.capacity = encode, dtype, capacity
        self.bits = int(np.ceil(np.log2(capacity * 2)))
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.at = np.full(1 << self.bits, -1, np.int32)
        self.n, self.used = 0, 0
        self.starts, self.lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.pool = np.zeros(1 << 16, self.dtype)
        self.flags = np.zeros(1024, np.uint8)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.bits) - 1)
        slot = (keys & mask).astype(np.int64)
        found = np.full(len(keys), -1, np.int32)
        left = np.arange(len(keys))
        while len(left):
            at = self.at[slot]
            hit = (at >= 0) & (self.keys[slot] == keys[left])
            found[left[hit]] = at[hit]
            go = (at >= 0) & ~hit
            left, slot = left[go], (slot[go] + 1) & int(mask)
        return found

    def _insert(self, keys: np.ndarray, entries: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (keys & np.uint64(mask)).astype(np.int64)
        while len(keys):
            free = self.at[slot] < 0
            self.at[slot[free]] = entries[free]
            won = free & (self.at[slot] == entries)
            self.keys[slot[won]] = keys[won]
            lost = ~won
            keys, entries, slot = keys[lost], entries[lost], (slot[lost] + np.where(free[lost], 0, 1)) & mask

    @staticmethod
    def _grown(x: np.ndarray, n: int) -> np.ndarray:
        if n <= len(x):
            return x
        out = np.zeros(max(n, len(x) * 3 // 2), x.dtype)
        out[: len(x)] = x
        return out

    def _learn(self, keys: np.ndarray, texts: list[str], first: np.ndarray) -> np.ndarray:
        got = self.encode(texts, first)
        values, flags = got if isinstance(got, tuple) else (got, None)
        if isinstance(values, Flat):
            lengths, flat = values.lengths, values.values
        elif isinstance(values, np.ndarray):  # rows of one length
            lengths, flat = np.full(len(values), values.shape[1], np.int64), values.reshape(-1)
        else:
            lengths = np.fromiter(map(len, values), np.int64, len(values))
            flat = np.fromiter((x for v in values for x in v), self.dtype, int(lengths.sum()))
        n, total = self.n + len(lengths), int(lengths.sum())
        entries = np.arange(self.n, n, dtype=np.int32)
        self.starts, self.lengths = self._grown(self.starts, n), self._grown(self.lengths, n)
        self.flags, self.pool = self._grown(self.flags, n), self._grown(self.pool, self.used + total)
        self.starts[entries] = self.used + np.cumsum(lengths) - lengths
        self.lengths[entries] = lengths
        if flags is not None:
            self.flags[entries] = flags
        self.pool[self.used : self.used + total] = flat
        self.n, self.used = n, self.used + total
        self._insert(keys, entries)
        return entries

    def entries(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The table's entry of each chunk; new chunks are encoded, each distinct one once."""
        keys = hash_spans(data, starts, ends)
        keys = np.where(first, mix(keys + np.uint64(1)), keys)
        found = self._find(keys)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            fresh, where, back = np.unique(keys[miss], return_index=True, return_inverse=True)
            where = miss[where]
            raw = data.tobytes() if len(data) < 32 * _GROUP_BYTES else data
            texts = [(raw[a:b] if isinstance(raw, bytes) else raw[a:b].tobytes()).decode("utf-8", "replace") for a, b in zip(starts[where].tolist(), ends[where].tolist())]
            found[miss] = self._learn(fresh, texts, first[where])[back]
        return found

    def groups(self, data: np.ndarray, offsets: np.ndarray):
        """(entries, first chunk, last chunk) for runs of chunks of a bounded size; chunk counts before each offset come first."""
        starts, before = chunk_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        first = np.zeros(len(starts), bool)
        first[before[:-1][before[1:] > before[:-1]]] = True
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + _GROUP_BYTES, "right")))
            if self.n + (to - at) > self.capacity and self.n:
                self._reset()
            yield self.entries(data, starts[at:to], ends[at:to], first[at:to]), at, to
            at = to
        self.before = before

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of values of each text."""
        sums = [np.zeros(1, np.int64)]
        self.before = np.zeros(len(offsets), np.int64)
        for entries, _, _ in self.groups(data, offsets):
            sums.append(self.lengths[entries].astype(np.int64))
        total = np.cumsum(np.concatenate(sums))
        return total[self.before[1:]] - total[self.before[:-1]]

    def values(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All values in a row, n + 1 offsets by text, and whether any chunk of a text was flagged."""
        out, sizes, flags = [np.zeros(0, self.dtype)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        self.before = np.zeros(len(offsets), np.int64)
        for entries, _, _ in self.groups(data, offsets):
            lengths = self.lengths[entries]
            out.append(self.pool[flat_index(self.starts[entries], lengths)])
            sizes.append(lengths.astype(np.int64))
            flags.append(self.flags[entries].astype(np.int64))
        size, flag = np.cumsum(np.concatenate(sizes)), np.cumsum(np.concatenate(flags))
        return np.concatenate(out), size[self.before], flag[self.before[1:]] > flag[self.before[:-1]]
