import random
import zlib

import pytest
from pyspark.sql import functions as F

from marquee.llm import hilbert_shards as H
from marquee.llm.queries import QUERIES


def walk(n, bits):
    """Cells of a Hilbert curve through a cube of n axes in order, by taking the curve apart recursively (n = 2)."""
    assert n == 2
    if bits == 0:
        return [(0, 0)]
    half, quarter = 1 << (bits - 1), walk(2, bits - 1)
    return [(y, x) for x, y in quarter] + [(x, y + half) for x, y in quarter] + [(x + half, y + half) for x, y in quarter] + [(2 * half - 1 - y, half - 1 - x) for x, y in quarter]


@pytest.mark.parametrize("n, bits", [(1, 4), (2, 1), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_each_cell_and_only_neighbours(spark, n, bits):
    cells = [F.shiftright("id", i * bits).bitwiseAND(F.lit(2**bits - 1)) for i in range(n)]
    grid = spark.range(2 ** (n * bits)).select(*[c.alias(f"c{i}") for i, c in enumerate(cells)])
    rows = H.with_curve(grid, [F.col(f"c{i}") for i in range(n)], bits).orderBy("curve").collect()
    assert [r.curve for r in rows] == list(range(2 ** (n * bits)))
    if n > 1:
        assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in zip(rows, rows[1:]))
    if n == 2:
        path = [(r.c0, r.c1) for r in rows]
        assert path in (walk(2, bits), [(y, x) for x, y in walk(2, bits)])


def made():
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["text", "other text é", "", None, "x" * 3000]), rnd.choice(["de", "en", None]), "src0" if i % 3 == 0 else f"src{rnd.randrange(20)}", rnd.choice([None, 5, 70, 900]), f"c{i}") for i in range(500)]
    return rows + [(None, "no id", "en", "src1", 1, "a"), (7, "again", "en", "src1", 2, "b"), (7, "again", "en", "src1", 2, "b")] + [(9, "same", "fr", "src0", 3, "c")] * 300


def test_shards(spark, tmp_path):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, curve string").repartition(5)
    H.write_shards(docs, f"{tmp_path}/a", run_bytes=2000)
    found = H.read_shards(spark, f"{tmp_path}/a")
    got = found.select("row.*", "size", F.col("shard"), F.col("slot")).collect()
    assert sorted(repr(tuple(r)[:6]) for r in got) == sorted(map(repr, rows))
    assert all(r.size == 8 + len((r.text or "").encode()) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    # the order of shards and slots is that of the curve
    curve = [r.curve for r in found.select("curve", "shard", "slot").orderBy("shard", "slot").collect()]
    assert curve == sorted(curve)
    # only files that can hold such rows are read, and none of them is missed
    part = H.read_shards(spark, f"{tmp_path}/a", {"lang": ("en", "en"), "n_chars": (0, 80)})
    wanted = [r for r in rows if r[2] == "en" and r[4] is not None and r[4] <= 80]
    assert part.count() == len(wanted) and len(part.inputFiles()) < len(found.inputFiles())
    assert H.read_shards(spark, f"{tmp_path}/a", {"lang": ("zz", "zz")}).count() == 0
    two = H.read_shards(spark, f"{tmp_path}/a", shards=[0, 23])
    assert {(r.shard, r.slot) for r in two.select("shard", "slot").collect()} == {(s, i) for s in (0, 23) for i in by[s]}
    runs = spark.read.parquet(f"{tmp_path}/a/runs").collect()
    assert sum(r.n for r in runs) == len(rows) and sum(r.bytes for r in runs) == sum(r.size for r in got)


def test_other_dimensions_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame(made(), "doc_id long, text string, lang string, source string, n_chars int, part string")
    H.write_shards(docs.limit(0), f"{tmp_path}/none")
    assert H.read_shards(spark, f"{tmp_path}/none").count() == 0
    H.write_shards(docs.drop("lang", "source", "n_chars"), f"{tmp_path}/plain", shards=3)
    assert sorted(r["count"] for r in H.read_shards(spark, f"{tmp_path}/plain").groupBy("shard").count().collect()) == [268, 268, 267][::-1]
    dated = docs.withColumns({"day": F.date_add(F.lit("2020-01-01").cast("date"), F.coalesce("n_chars", F.lit(0))), "odd": F.col("doc_id") % 2 == 1, "none": F.lit(None).cast("string")})
    H.write_shards(dated, f"{tmp_path}/dated", dimensions=("day", "odd", "none"), shards=2)
    assert H.read_shards(spark, f"{tmp_path}/dated").count() == len(made())
    with pytest.raises(ValueError, match="no order"):
        H.write_shards(docs.withColumn("a", F.array("lang")), f"{tmp_path}/bad", dimensions=("a",))


def test_query(spark, tmp_path):
    rows = made()
    spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op11_hilbert_shards"](spark, str(tmp_path))
    got = found.collect()
    assert sorted(repr((r.doc_id, r["size"], r.text_crc32)) for r in got) == sorted(repr((r[0], 8 + len((r[1] or "").encode()), zlib.crc32((r[1] or "").encode()))) for r in rows)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)} and {r.shard for r in got} == set(range(24))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
