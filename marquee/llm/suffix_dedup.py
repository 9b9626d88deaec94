"""Substring dedup after prefix-free parsing.

Triggers of a rolling hash cut each text into phrases. A trigger is the place with the least
hash of some 400-byte string, so each such string holds one, at the same place in all its
copies, and belongs to it. All strings of a trigger lie in one phrase with its surroundings.

The dictionary of phrases decides most cases: a phrase that occurs twice is repeated wholly, and
one whose core is unique isn't repeated at all. What is left lies at the edges of repeats. There
two orders are made over all phrases of the dictionary: the suffix array of what follows their
triggers in the parse, and that of what precedes them in the phrase, read backwards. A string of
400 bytes is an interval of common prefixes in each. Phrases that share a pair of intervals share
the strings of that pair, so that the two together give the order of all strings in the corpus.
Both orders are dealt out by ranges; no group of phrases has to lie in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import finished, settled, written
from .text import flat_index, mix, pieces, utf8

#: Bytes of a string, of the core at a trigger, and of the rolling hash.
LENGTH, CORE, ROLL = 400, 64, 16
#: Rows of an order that are taken in one step, where a core ends.
_STEP = 50_000
_SPAN = LENGTH - CORE + 1
_PLACE = np.uint64((1 << 31) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))


def triggers(data: np.ndarray) -> np.ndarray:
    """For each start of a 400-byte string, the place of its trigger: its least rolling hash, the last of equal ones."""
    h = _BYTES[data]
    step, power = 1, _BASE
    with np.errstate(over="ignore"):
        while step < ROLL:
            h[: len(h) - step] = h[: len(h) - step] * power + h[step:]
            power, step = power * power, step * 2
    key = (mix(h) & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64))
    width = 1
    while width * 2 <= _SPAN:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    if _SPAN > width:
        key = np.minimum(key[: len(key) - (_SPAN - width)], key[_SPAN - width :])
    return (_PLACE - (key & _PLACE)).astype(np.int64)


def phrases(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, first string, trigger, last string) of each phrase, as places in `data`."""
    if len(data) < LENGTH:
        return (np.zeros(0, np.int64),) * 4
    owner = triggers(data)
    starts, ends = offsets[:-1], np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1])
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    at = np.flatnonzero(np.cumsum(inside[: len(owner)]) > 0)
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    own = owner[at]
    fresh = np.r_[True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]
    first = at[fresh]
    last = np.r_[at[np.flatnonzero(fresh)[1:] - 1], at[-1]]
    return np.searchsorted(offsets, first, "right") - 1, first, own[fresh], last


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(core, s1, s2, key, place): each phrase's core and whole as hashes, its text and its place there."""
    for batch in pieces(batches):
        data, offsets = utf8(batch.column("text"))
        which, first, trigger, last = phrases(data, offsets)
        raw = data.tobytes()
        ends = (last + LENGTH).tolist()
        whole = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(first.tolist(), ends)]), np.int64).reshape(-1, 2)
        core = np.fromiter((xxhash.xxh3_64_intdigest(raw[m : m + CORE]) for m in trigger.tolist()), np.uint64, len(trigger)).view(np.int64)
        place = (first - offsets[which]) << 20 | (trigger - first) << 10 | (last - first)
        yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(whole[:, 0]), pa.array(whole[:, 1]), batch.column("key").take(pa.array(which)), pa.array(place)], ["core", "s1", "s2", "key", "place"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases asked for: (core, key, place, alone), the bytes from the trigger on and those before it, backwards."""
    for batch in pieces(batches):
        data, offsets = utf8(batch.column("text"))
        asked = batch.column("asked")
        n = np.asarray(asked.value_lengths().fill_null(0))
        which = np.repeat(np.arange(batch.num_rows), n)
        rows = asked.flatten()
        place = rows.field("place").to_numpy(zero_copy_only=False)
        first = offsets[which] + (place >> 20)
        trigger, end = first + (place >> 10 & 1023), first + (place & 1023) + LENGTH
        raw = data.tobytes()
        after = [raw[a:b] for a, b in zip(trigger.tolist(), end.tolist())]
        before = [raw[a:b][::-1] for a, b in zip(first.tolist(), trigger.tolist())]
        yield pa.RecordBatch.from_arrays([rows.field("core"), batch.column("key").take(pa.array(which)), rows.field("place"), rows.field("alone"), pa.array(after, pa.binary()), pa.array(before, pa.binary())], ["core", "key", "place", "alone", "after", "before"])


def _common(rows: list[bytes], width: int) -> np.ndarray:
    """Lengths of the common prefixes of neighbours."""
    table = np.zeros((len(rows), width + 1), np.uint8)
    sizes = np.array([len(r) for r in rows])
    table[np.arange(width + 1)[None, :] < sizes[:, None]] = np.frombuffer(b"".join(rows), np.uint8)
    differ = table[1:] != table[:-1]
    differ[:, width] = True
    return np.minimum(differ.argmax(axis=1), np.minimum(sizes[1:], sizes[:-1]))


def intervals(common: list[int], floor: int) -> list[tuple[int, int, int, int]]:
    """(low, high, start, end) of all intervals of at least two rows: those that share a prefix of each length in (low, high].

    common[i] is the common prefix of rows i - 1 and i; `floor` stands where a core begins.
    """
    out: list[tuple[int, int, int, int]] = []
    stack: list[tuple[int, int]] = []  # (common prefix, start)
    for i, c in enumerate([*common[1:], floor], 1):
        start = i - 1
        while stack and stack[-1][0] > c:
            high, start = stack.pop()
            out.append((max(c, stack[-1][0]) if stack else c, high, start, i))
        if c > floor and (not stack or stack[-1][0] < c):
            stack.append((c, start))
    return out


_INTERVALS = "array<struct<low: int, high: int, start: long, end: long>>"
_INTERVAL_LIST = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
_ORDER = [("part", pa.int32()), ("key", pa.int64()), ("place", pa.int64()), ("alone", pa.bool_()), ("found", _INTERVAL_LIST), ("n", pa.int64()), ("first_core", pa.int64()), ("first", pa.binary()), ("last_core", pa.int64()), ("last", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary())]
_ORDER_SQL = f"part int, key long, place long, alone boolean, found {_INTERVALS}, n long, first_core long, first binary, last_core long, last binary, starts binary, ends binary"


def _packed(numbers: np.ndarray) -> bytes:
    """A step function in few bytes."""
    return zlib.compress(np.ascontiguousarray(numbers, "<i8").tobytes())


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), "<i8")


def _in_order(text: str, width: int, floor: int):
    """For rows in the order of (core, text): each row's intervals in its partition, and last a row about the partition.

    The latter has the partition's first and last texts, and by length where the interval of the
    last row starts and that of the first one ends, so that intervals can be joined across
    partitions. The first and last rows also have intervals of themselves alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        core = key = place = np.zeros(0, np.int64)
        alone, common = np.zeros(0, bool), np.zeros(0, np.int64)
        first = last = None
        ends = np.zeros(width + 1, np.int64)

        def step(n: int, ended: bool) -> Iterator[pa.RecordBatch]:
            """The intervals of the next n rows, which are whole cores of this partition."""
            nonlocal at, core, key, place, alone, common
            found = np.array(intervals(common[:n].tolist(), floor), np.int64).reshape(-1, 4)
            own = []
            if at == 0:
                own.append((common[1] if n > 1 else floor, len(first[1]), 0, 1))
            if ended and at + n > 1:
                own.append((common[n - 1], len(last[1]), n - 1, n))
            found = np.concatenate([found, np.array(own, np.int64).reshape(-1, 4)])
            sizes = found[:, 3] - found[:, 2]
            row, which = flat_index(found[:, 2], sizes), np.repeat(np.arange(len(found)), sizes)
            order = np.lexsort([found[which, 0], row])
            row, which = row[order], which[order]
            found[:, 2:] += at
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(found[which, c].astype(np.int32 if c < 2 else np.int64)) for c in range(4)], ["low", "high", "start", "end"]))
            if at == 0:
                for low, high, _, end in found[which[row == 0]].tolist():
                    ends[max(low, -1) + 1 : high + 1] = end
            none = [pa.nulls(n, kind) for _, kind in _ORDER[5:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(key[:n]), pa.array(place[:n]), pa.array(alone[:n]), lists.cast(_INTERVAL_LIST), *none], schema=pa.schema(_ORDER))
            if ended:
                starts = np.full(width + 1, at + n - 1, np.int64)
                for low, high, start, _ in found[which[row == n - 1]].tolist():
                    starts[max(low, -1) + 1 : high + 1] = start
                values = [part, None, None, None, None, at + n, *first, *last, _packed(starts), _packed(ends)]
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, (_, kind) in zip(values, _ORDER)], schema=pa.schema(_ORDER))
            at += n
            core, key, place, alone, common = core[n:], key[n:], place[n:], alone[n:], common[n:]

        for batch in batches:
            if not batch.num_rows:
                continue
            cores, texts = batch.column("core").to_numpy(zero_copy_only=False), batch.column(text).to_pylist()
            if first is None:
                first, ends[:] = (int(cores[0]), texts[0]), 1
                before = (int(cores[0]) - 1 if cores[0] else 1, b"")
            else:
                before = last
            shared = _common([before[1], *texts], width)
            shared[np.r_[before[0], cores[:-1]] != cores] = floor
            last = (int(cores[-1]), texts[-1])
            core, common = np.concatenate([core, cores]), np.concatenate([common, shared])
            key, place = (np.concatenate([x, batch.column(c).to_numpy(zero_copy_only=False)]) for x, c in ((key, "key"), (place, "place")))
            alone = np.concatenate([alone, batch.column("alone").to_numpy(zero_copy_only=False)])
            if len(core) >= _STEP and core[0] != core[-1]:
                yield from step(int(np.flatnonzero(core != core[-1])[-1]) + 1, False)
        if len(core):
            yield from step(len(core), True)

    return run


def _ordered(edges: DataFrame, text: str, width: int, floor: int) -> tuple[DataFrame, dict[int, tuple]]:
    """The rows (key, place, alone, part, found) of an order, and how intervals at the ends of its partitions go on in the others.

    Rows of one text are dealt out by their keys. Of each partition one row comes to the driver, which has two texts and two
    step functions of at most `width` steps.
    """
    dealt = edges.select("core", "key", "place", "alone", text).repartitionByRange("core", text, "key", "place").sortWithinPartitions("core", text, "key", "place")
    table = written(dealt.mapInArrow(_in_order(text, width, floor), _ORDER_SQL), f"order-{text}")
    about = sorted(table.where("n IS NOT NULL").drop("key", "place", "alone", "found").collect(), key=lambda r: r.part)
    joint = [-1] + [int(_common([bytes(x["last"]), bytes(y["first"])], width)[0]) if x.last_core == y.first_core else -1 for x, y in zip(about, about[1:])] + [-1]
    bases = np.cumsum([0] + [r.n for r in about])
    lengths = np.arange(width + 1)
    starts, ends, now = [], [], np.zeros(width + 1, np.int64)
    for k, r in enumerate(about):
        own = _unpacked(r.starts)
        now = np.where((own == 0) & (lengths <= joint[k]), now, own + bases[k])
        starts.append(_packed(now))
    for k in range(len(about) - 1, -1, -1):
        own = _unpacked(about[k].ends)
        now = np.where((own == about[k].n) & (lengths <= joint[k + 1]), now, own + bases[k])
        ends.append(_packed(now))
    ends.reverse()
    carried = {r.part: (int(bases[k]), r.n, joint[k], starts[k - 1] if k else None, joint[k + 1], ends[k + 1] if k + 1 < len(about) else None) for k, r in enumerate(about)}
    return table.where("n IS NULL").select("part", "key", "place", "alone", "found"), carried


def _whole(part: tuple, low: int, high: int, start: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """An interval as it is over all partitions, by shorter and longer common prefixes; none of one row."""
    base, n, left, starts, right, ends = part
    if (start or left <= low) and (end < n or right <= low):
        if end - start > 1:
            yield low, high, start + base, end + base
        return
    lengths = np.arange(low + 1, high + 1)
    first = np.where((start == 0) & (lengths <= left), _unpacked(starts)[lengths] if starts is not None else 0, start + base)
    last = np.where((end == n) & (lengths <= right), _unpacked(ends)[lengths] if ends is not None else 0, end + base)
    cuts = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (last[1:] != last[:-1]), True])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if last[a] - first[a] > 1:
            yield low + a, low + b, int(first[a]), int(last[a])


def _pairs(after: dict[int, tuple], before: dict[int, tuple]):
    """(key, place, alone, a_start, a_end, b_start, b_end, low, high) for the pairs of intervals that hold strings of a phrase.

    The strings are those that start low to high bytes before the trigger.
    """
    names = ["key", "place", "alone", "a_start", "a_end", "b_start", "b_end", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for side, carried in (("a", after), ("b", before)):
                lists = batch.column(f"{side}_found")
                flat = lists.flatten()
                fields = list(zip(*(flat.field(c).to_pylist() for c in ("low", "high", "start", "end"))))
                bounds = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))]).tolist()
                parts = batch.column(f"{side}_part").to_pylist()
                sides.append([[x for f in fields[i:j] for x in _whole(carried[p], *f)] for i, j, p in zip(bounds, bounds[1:], parts)])
            row, out = [], []
            for k, (mine, theirs) in enumerate(zip(*sides)):
                b = 0
                for low, high, start, end in reversed(mine):  # from the longest common prefix on, that is from the nearest strings
                    near, far = LENGTH - high, LENGTH - low - 1
                    while b < len(theirs) and theirs[b][1] < near:
                        b += 1
                    at = b
                    while at < len(theirs) and theirs[at][0] < far:
                        x, y = max(near, theirs[at][0] + 1), min(far, theirs[at][1])
                        if x <= y:
                            row.append(k)
                            out.append((start, end, theirs[at][2], theirs[at][3], x, y))
                        at += 1
            numbers, rows = np.array(out, np.int64).reshape(-1, 6), pa.array(np.array(row, np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in names[:3]), *(pa.array(numbers[:, c]) for c in range(6))], names)

    return run


def merged(ranges: list) -> list[tuple[int, int]]:
    """Ranges that neither overlap nor touch, in order."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        data, offsets = utf8(batch.column("text"))
        raw = data.tobytes()
        lists = batch.column("ranges").to_pylist()
        spans, kept = [], []
        for ranges, a, b in zip(lists, offsets[:-1].tolist(), offsets[1:].tolist()):
            own = merged([(r["from"], r["to"]) for r in ranges or []])
            text, at, left = raw[a:b], 0, []
            for x, y in own:
                left.append(text[at:x])
                at = y
            left.append(text[at:])
            spans.append([{"from": x, "to": y} for x, y in own])
            kept.append(b"".join(left))
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept_bytes"])


def _ranges(keyed: DataFrame) -> DataFrame:
    """Rows (key, ranges): the ranges of repeated strings of each text, not yet merged."""
    parsed = keyed.select("key", "text").mapInArrow(_parse, "core long, s1 long, s2 long, key long, place long")
    shared = parsed.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core")
    shared = settled(shared, "shared-cores")
    live = written(parsed.join(shared, "core"), "phrases")

    dictionary = live.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "place")).alias("first"))
    dictionary = settled(dictionary, "dictionary")
    known = live.join(dictionary, ["s1", "s2"]).select("core", "key", "place", (F.col("n") == 1).alias("alone"), ((F.col("first.key") == F.col("key")) & (F.col("first.place") == F.col("place"))).alias("stands"))
    known = written(known, "known-phrases")
    lone = known.where("alone").select("core").distinct()
    stands = known.where("stands AND NOT alone").join(lone, "core", "left_semi")
    asked = known.where("alone").unionByName(stands.select(known.columns)).dropDuplicates(["key", "place"])
    asked = written(asked.groupBy("key").agg(F.collect_list(F.struct("core", "place", "alone")).alias("asked")), "edges")

    # The texts are dealt out by key once: both joins with them read the same exchange.
    edges = keyed.join(asked, "key").select("key", "text", "asked").mapInArrow(_edges, "core long, key long, place long, alone boolean, after binary, before binary")
    edges = written(edges, "edge-phrases")
    after, after_ends = _ordered(edges, "after", LENGTH, CORE - 1)
    before, before_ends = _ordered(edges, "before", _SPAN - 1, -1)
    side = lambda rows, x: rows.select("key", "place", "alone", F.col("part").alias(f"{x}_part"), F.col("found").alias(f"{x}_found"))
    both = side(after, "a").join(side(before, "b").drop("alone"), ["key", "place"])
    pair = ["a_start", "a_end", "b_start", "b_end"]
    pairs = written(both.mapInArrow(_pairs(after_ends, before_ends), "key long, place long, alone boolean, " + ", ".join(f"{c} long" for c in pair) + ", low long, high long"), "interval-pairs")
    again = settled(pairs.groupBy(*pair).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "shared-pairs")
    trigger = F.shiftright("place", 20) + F.shiftright("place", 10).bitwiseAND(1023)
    found = pairs.where("alone").join(again, pair).select("key", (trigger - F.col("high")).alias("from"), (trigger - F.col("low") + LENGTH).alias("to"))
    first = F.shiftright("place", 20)
    whole = known.where("NOT alone").select("key", first.alias("from"), (first + F.col("place").bitwiseAND(1023) + LENGTH).alias("to"))
    return whole.unionByName(found).groupBy("key").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))


def substring_dedup(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, spans, kept_bytes), one for each row of `docs`.

    spans are the maximal runs of bytes that some 400-byte string covers which also starts
    elsewhere in the table, in the same text or another; kept_bytes are the others in a row
    (a run may cut a character of several bytes). Null is an empty text, and texts of fewer
    than 400 bytes are kept whole. Rows with an equal doc_id are told apart by their texts, and
    equal rows remove each other. Other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    ranges = finished(lambda: _ranges(keyed), "ranges")
    return keyed.join(ranges, "key", "left").select("key", "doc_id", "text", "ranges").mapInArrow(_removed, f"doc_id {kind}, n_bytes long, spans array<struct<from: long, to: long>>, kept_bytes binary")
