"""Taste profiles kept as state while plays arrive, instead of being counted anew.

A play's tenths fall when it is 30, 90 and 365 days old, so a timer waits for the next of these ages. The
clock is the watermark over arrival times; a play may arrive long after it happened, in any
order and repeatedly, and the last time of an item counts.

State holds the last plays of some users together, as arrays: a call into the state costs as much
for one user as for all of these. It gives the tenths by which plays change; what they mean for a
profile's numbers is a join with the items' facets, outside of Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

DAY = 86_400_000
#: Ages in days at which the tenths of a play fall, and the tenths before each and after the last.
FALLS, TENTHS, UNKNOWN = (30, 90, 365), (15, 10, 6, 3), 7
#: Users of one state, as a power of two: those whose ids differ in the last bits only.
TOGETHER = 6
CHANGES = "user_id long, facet string, value string, change long"
NUMBERS = "user_id long, facet string, value string, num long, version long"
_TIMES = "user_id long, item_id long, change int"
_UNTIMED = np.iinfo(np.int64).min
_STATE = "plays array<struct<item_id: bigint, last: bigint, facets: array<struct<facet: string, value: string, weight: int>>>>, nums array<struct<facet: string, value: string, num: bigint>>, version bigint"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tenths_at(last: int | None, now: int) -> int:
    """The tenths of a play of the time `last`, both in milliseconds; full days count."""
    if last is None:
        return UNKNOWN
    days = (now - last) // DAY if now >= last else 0
    return TENTHS[sum(days >= f for f in FALLS)]


def counted(plays: dict[int, tuple[int | None, list]], now: int) -> dict[tuple[str, str], int]:
    """The profile's numbers by (facet, value)."""
    nums: dict[tuple[str, str], int] = {}
    for last, facets in plays.values():
        tenths = tenths_at(last, now)
        for facet, value, weight in facets:
            nums[facet, value] = nums.get((facet, value), 0) + weight * tenths
    return nums


class PlayTimes(StatefulProcessor):
    """The last plays of some users, as rows (user, item, time, tenths) of 64 bits; gives the plays whose tenths change, and by how much."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("times", "plays binary")

    def _held(self) -> np.ndarray:
        held = self.state.get()
        return np.frombuffer(held[0] if held else b"", np.int64).reshape(-1, 4)

    def _keep(self, plays: np.ndarray, now: int) -> Iterator[Row]:
        user, item, last, before = plays.T
        days = np.maximum(now - last, 0) // DAY
        tenths = np.where(last == _UNTIMED, UNKNOWN, np.array(TENTHS)[np.searchsorted(FALLS, days, side="right")])
        known = last[last != _UNTIMED]
        falls = np.concatenate([known + age * DAY for age in FALLS])
        falls = falls[falls > now]
        if len(falls):
            self.handle.registerTimer(int(falls.min()))  # one, at the next fall of any play; when it ends, the next is set
        self.state.update((np.column_stack([user, item, last, tenths]).tobytes(),))
        for k in np.flatnonzero(tenths != before).tolist():
            yield Row(user_id=int(user[k]), item_id=int(item[k]), change=int(tenths[k] - before[k]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = np.array([(r[1], r[2], _UNTIMED if r[3] is None else r[3], 0) for r in rows], np.int64).reshape(-1, 4)
        plays = np.concatenate([self._held(), new])
        plays = plays[np.lexsort((plays[:, 2], plays[:, 1], plays[:, 0]))]
        begins = np.flatnonzero(np.append(True, (plays[1:, :2] != plays[:-1, :2]).any(axis=1)))
        latest = plays[np.append(begins[1:], len(plays)) - 1]  # of an item's times the greatest
        latest[:, 3] = np.add.reduceat(plays[:, 3], begins)  # one at most was held
        yield from self._keep(latest, max(0, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._keep(self._held(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


class Profiles(StatefulProcessor):
    """One user's plays and numbers; gives the numbers that change, each with the profile's version."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("profile", _STATE)

    def _held(self) -> tuple[dict, dict, int]:
        if not self.state.exists():
            return {}, {}, 0
        plays, nums, version = self.state.get()
        return {p[0]: (p[1], [tuple(f) for f in p[2]]) for p in plays}, {(n[0], n[1]): n[2] for n in nums}, version

    def _wait(self, plays: dict, now: int) -> None:
        """One timer, at the next fall of any play; when it ends, the next is set."""
        falls = [last + age * DAY for last, _ in plays.values() if last is not None for age in FALLS if last + age * DAY > now]
        if falls:
            self.handle.registerTimer(min(falls))

    def _changes(self, key: tuple, plays: dict, before: dict, version: int, now: int) -> Iterator[Row]:
        nums = counted(plays, now)
        changed = [(k, nums.get(k, 0)) for k in sorted({*nums, *before}) if nums.get(k, 0) != before.get(k, 0)]
        self.state.update(([(i, last, facets) for i, (last, facets) in plays.items()], [(*k, n) for k, n in nums.items()], version + 1))
        for (facet, value), num in changed:
            yield Row(user_id=key[0], facet=facet, value=value, num=num, version=version + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        plays, before, version = self._held()
        now = max(0, timerValues.getCurrentWatermarkInMs())
        for r in rows:
            last, facets = plays.get(r.item_id, (None, None))
            if facets is None or (r.last is not None and (last is None or r.last > last)):
                last = r.last if r.last is not None else last
            plays[r.item_id] = last, [(f["facet"], f["value"], f["weight"]) for f in r.facets]
        self._wait(plays, now)
        yield from self._changes(key, plays, before, version, now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        plays, before, version = self._held()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        self._wait(plays, now)
        yield from self._changes(key, plays, before, version, now)

    def close(self) -> None:
        pass


def _last() -> Column:
    """last_played in milliseconds."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("last_played")).alias("last")


def profile_changes(plays: DataFrame, item_facets: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """A stream of changes of numbers (user_id, facet, value, change) from a stream of plays; a number is the sum of its changes.

    `plays` has user_id, item_id, last_played (timestamp_ntz, may be null) and arrived (timestamp),
    `item_facets` is profile.facets' result, best as a table: each batch reads it.
    """
    together = F.call_function("shiftright", F.col("user_id"), F.lit(TOGETHER)).alias("users")
    rows = plays.withWatermark("arrived", delay).select(together, "user_id", "item_id", _last(), "arrived")
    times = rows.groupBy("users").transformWithState(PlayTimes(), _TIMES, "Append", "EventTime")
    return times.join(item_facets, "item_id").select("user_id", "facet", "value", (F.col("change") * F.col("weight")).cast("long").alias("change"))


def profile_numbers(plays: DataFrame, item_facets: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """A stream of changed numbers (user_id, facet, value, num, version), for whom changes don't do; input as of profile_changes.

    Each user has a state of its own with the facets of all plays, which costs some milliseconds whenever it is touched. A number that
    falls to none is given as 0.
    """
    of = item_facets.groupBy("item_id").agg(F.collect_list(F.struct("facet", "value", F.col("weight").cast("int").alias("weight"))).alias("facets"))
    rows = plays.withWatermark("arrived", delay).join(of, "item_id", "left").select("user_id", "item_id", _last(), F.coalesce("facets", F.array().cast("array<struct<facet: string, value: string, weight: int>>")).alias("facets"), "arrived")
    return rows.groupBy("user_id").transformWithState(Profiles(), NUMBERS, "Append", "EventTime")


@contextmanager
def _rocks(spark: SparkSession):
    """Streams that start within keep their state in RocksDB, on disk with change logs."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def keep_profiles(changes: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write the changes to Parquet: every so often, or over all plays that are there."""
    writer = changes.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    with _rocks(changes.sparkSession):
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start(out)


def read_profiles(spark: SparkSession, out: str) -> DataFrame:
    """Rows (user_id, facet, value, num): the profiles as of the last change, as profile.accumulate gives them."""
    sums = spark.read.schema(CHANGES).parquet(out).groupBy("user_id", "facet", "value").agg(F.sum("change").alias("num"))
    return sums.where("num > 0")
