from marquee.operators import profile
from marquee.plans import fixtures

SF = "/root/testdata/sf0.001"


def test_partitions_follow_the_rows(spark, monkeypatch):
    lib = fixtures.Library(spark, SF)
    plays, facets = lib.plays(), profile.facets(lib.item_genres(), lib.item_people())
    plain = profile.accumulate(plays, facets, fixtures.AS_OF).collect()
    monkeypatch.setattr(fixtures, "PART_ROWS", 500)
    parts = lib.parts("lineitem")
    assert parts == -(-lib.table("lineitem").count() // 500) > 4
    more = profile.accumulate(lib.plays(), facets, fixtures.AS_OF, parts)
    assert more.rdd.getNumPartitions() == lib.plays().rdd.getNumPartitions() == lib.item_people().rdd.getNumPartitions() == parts
    assert sorted(more.collect()) == sorted(plain)
