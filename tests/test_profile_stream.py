import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marquee.operators import profile
from marquee.streaming import profiles as P

PLAYS = "user_id long, item_id long, last_played timestamp_ntz, arrived timestamp"
DAY0 = datetime(2024, 1, 1)


def facets(spark):
    genres = spark.createDataFrame([(i, f"g{i % 3}") for i in range(12)] + [(1, "g1")], "item_id long, genre string")
    people = spark.createDataFrame([(i, f"p{i % 4}", ["Actor", "Director", "Writer"][i % 3]) for i in range(11)], "item_id long, person string, type string")
    return profile.facets(genres, people)


def arrive(spark, path, rows, when):
    table = spark.createDataFrame([(u, i, t, None) for u, i, t in rows], PLAYS).withColumn("arrived", F.to_utc_timestamp(F.lit(when.isoformat(sep=" ")), F.current_timezone()))
    table.coalesce(1).write.mode("append").parquet(path)


def test_equal_to_counting_anew_at_every_clock(spark, tmp_path):
    rnd, of, known = random.Random(9), facets(spark), {}
    ages = [0, 1, 29, 30, 31, 89, 90, 91, 364, 365, 366, 800]
    now = DAY0
    for step in range(4):
        now += timedelta(days=[0, 30, 61, 275][step])
        rows = []
        for _ in range(60):  # in any order, some long ago, some again with an older or no time
            when = rnd.choice([None, *[now - timedelta(days=a, hours=rnd.choice([0, 0, 5])) for a in ages]])
            rows.append((rnd.randrange(5), rnd.randrange(14), when))
        if step == 3:
            rows = [(99, -1, None)]  # nothing but the clock
        arrive(spark, f"{tmp_path}/in", rows, now + timedelta(milliseconds=1))
        for u, i, t in rows:
            if (u, i) not in known or (t is not None and (known[u, i] is None or t > known[u, i])):
                known[u, i] = t
        stream = spark.readStream.schema(PLAYS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = P.keep_profiles(P.profile_changes(stream, of), f"{tmp_path}/out", f"{tmp_path}/state")  # each time from its checkpoint
        assert query.awaitTermination(120) and query.exception() is None
        plays = spark.createDataFrame([(u, i, t) for (u, i), t in known.items()], "user_id long, item_id long, last_played timestamp_ntz")
        batch = profile.accumulate(plays, of, now.isoformat(sep=" "))
        assert sorted(P.read_profiles(spark, f"{tmp_path}/out").collect()) == sorted(batch.collect())


def test_tenths():
    day = P.DAY
    assert [P.tenths_at(0, a * day - b) for a, b in ((30, 1), (30, 0), (90, 1), (90, 0), (365, 1), (365, 0))] == [15, 10, 10, 6, 6, 3]
    assert P.tenths_at(None, 5) == 7 and P.tenths_at(9 * day, 0) == 15


def test_a_user_waits_for_one_fall_at_a_time():
    from types import SimpleNamespace as N

    from marquee.streaming.profiles import DAY, Profiles

    class State:
        kept = None
        exists = lambda self: self.kept is not None
        get = lambda self: self.kept

        def update(self, kept):
            self.kept = kept

    timers, times = [], N(getCurrentWatermarkInMs=lambda: 100 * DAY)
    user = Profiles()
    user.handle, user.state = N(registerTimer=timers.append), State()
    plays = [N(item_id=i, last=(90 + i) * DAY, facets=[{"facet": "genre", "value": "x", "weight": 1}]) for i in range(5)]
    assert [r.num for r in user.handleInputRows((1,), iter(plays), times)] == [75] and timers == [120 * DAY]
    late = N(getCurrentWatermarkInMs=lambda: 122 * DAY)
    assert [r.num for r in user.handleExpiredTimer((1,), late, N(getExpiryTimeInMs=lambda: 120 * DAY))] == [60] and timers == [120 * DAY, 123 * DAY]
