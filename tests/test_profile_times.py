from types import SimpleNamespace as N

import pytest
from pyspark.sql import functions as F

from marquee.operators import profile
from marquee.plans import queries
from marquee.plans.fixtures import AS_OF, Library
from marquee.streaming import profiles as P

SF = "/root/testdata/sf0.001"


class State:
    kept, calls = None, 0

    def get(self):
        self.calls += 1
        return self.kept

    def update(self, kept):
        self.calls += 1
        self.kept = kept


def test_users_share_a_state_without_facets():
    """Each user had a state of its own, with the facets of every play, which was read, decoded and written for each of them."""
    D, timers, state = P.DAY, [], State()
    users = P.PlayTimes()
    users.handle, users.state = N(registerTimer=timers.append), state
    at = lambda day: N(getCurrentWatermarkInMs=lambda: day * D)
    rows = [(0, u, i, (90 + i) * D, None) for u in range(64) for i in range(8)]
    changes = lambda found: [(r.user_id, r.item_id, r.change) for r in found]
    assert changes(users.handleInputRows((0,), iter(rows), at(100))) == [(u, i, 15) for u in range(64) for i in range(8)]
    assert state.calls == 2 and timers == [120 * D] and len(state.kept[0]) == 64 * 8 * 32
    assert changes(users.handleExpiredTimer((0,), at(121), N(getExpiryTimeInMs=lambda: 120 * D))) == [(u, i, -5) for u in range(64) for i in (0, 1)]
    assert timers == [120 * D, 122 * D]
    late = [(0, 3, 0, 10 * D, None), (0, 3, 0, None, None), (0, 3, 9, None, None), (0, 3, 9, None, None), (0, 3, 1, 500 * D, None), (0, 70, 5, 121 * D - 1, None)]
    assert changes(users.handleInputRows((0,), iter(late), at(121))) == [(3, 1, 5), (3, 9, 7), (70, 5, 15)]  # an older time and none change nothing
    assert changes(users.handleInputRows((0,), iter([(0, 3, 9, -5 * D, None)]), at(121))) == [(3, 9, -1)]


def test_arrivals_are_written_by_many_tasks(spark, monkeypatch):
    """Each arriving part was one file, written and read by one task."""
    lib, tasks, write = Library(spark, SF), [], type(spark.range(1).write).parquet
    def counted(self, path, *more, **how):
        if "arriving-plays" in path:
            tasks.append(self._df.rdd.getNumPartitions())
        return write(self, path, *more, **how)

    monkeypatch.setattr(type(spark.range(1).write), "parquet", counted)
    monkeypatch.setattr(Library, "snapshot", lambda self, df, tag: df)
    found = queries.facet_prefs_streamed(lib)
    plays = lib.plays()
    assert sorted(found.collect()) == sorted(profile.accumulate(plays, queries._facets(lib), AS_OF).collect())
    assert len(tasks) == 4 and min(tasks[:3]) >= plays.rdd.getNumPartitions() > 1


@pytest.mark.parametrize("stream", [P.profile_changes, P.profile_numbers])
def test_schemas(spark, tmp_path, stream):
    spark.createDataFrame([], "user_id long, item_id long, last_played timestamp_ntz, arrived timestamp").write.parquet(f"{tmp_path}/in")
    plays = spark.readStream.schema("user_id long, item_id long, last_played timestamp_ntz, arrived timestamp").parquet(f"{tmp_path}/in")
    facets = spark.range(1).select(F.col("id").alias("item_id"), F.lit("genre").alias("facet"), F.lit("x").alias("value"), F.lit(1).alias("weight"))
    assert dict(stream(plays, facets).dtypes) == {P.profile_changes: {"user_id": "bigint", "facet": "string", "value": "string", "change": "bigint"}, P.profile_numbers: {"user_id": "bigint", "facet": "string", "value": "string", "num": "bigint", "version": "bigint"}}[stream]
