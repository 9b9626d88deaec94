import pytest
from pyspark.sql import functions as F

from marquee.functions import scalars as S


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'int' if isinstance(v, int) else 'array<string>'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "days, tenths", [(0, 15), (29, 15), (30, 10), (89, 10), (90, 6), (364, 6), (365, 3), (-9, 15)]
)
def test_recency(spark, days, tenths):
    played = F.lit("2024-06-01 12:00:00").cast("timestamp_ntz") - F.make_interval(days=F.lit(days))
    assert spark.range(1).select(S.recency_tenths(played, "2024-06-01 12:00:00").alias("x")).first().x == tenths


def test_recency_counts_full_days_and_missing_times(spark):
    at = lambda text: one(spark, S.recency_tenths(S.parse_played(F.col("t")), "2024-03-02 00:00:00"), t=text)
    assert at("2024-02-01T00:00:01Z") == 15 and at("2024-01-31T23:00:00Z") == 10
    assert at(None) == at("bad") == at("") == 7
    assert at("2024-03-01T10:00:00.1234567Z") == 15


def test_times_with_offsets(spark):
    text = "2024-01-01T02:00:00+03:00"
    assert str(one(spark, S.parse_played(F.col("t")), t=text)) == "2023-12-31 23:00:00"
    assert one(spark, S.parse_played(F.col("t"), keep_offsets=False), t=text) is None


@pytest.mark.parametrize("name, safe", [("  A/B: C  ", "AB C"), ("x" * 49 + " y", "x" * 49), ("a-b_c 1!", "a-b_c 1"), ("Ünï 漢字²", "Ünï 漢字²"), ("///", "")])
def test_safe_name(spark, name, safe):
    assert one(spark, S.safe_name(F.col("n")), n=name) == safe


def test_artist(spark):
    assert one(spark, S.artist(F.col("a"), F.col("b")), a="X", b=["Y"]) == "X"
    assert one(spark, S.artist(F.col("a"), F.col("b")), a="", b=["Y", "Z"]) == "Y"
    assert one(spark, S.artist(F.col("a"), F.col("b")), a=None, b=[]) == "Unknown"


def test_escape(spark):
    assert one(spark, S.escape_xml(F.col("t")), t="<a & 'b'>\"") == "&lt;a &amp; &apos;b&apos;&gt;&quot;"
    assert one(spark, S.escape_xml(F.col("t")), t=None) == ""


def test_paths(spark):
    rules = [("/a/b", "/x"), ("/a", "/y")]
    assert one(spark, S.resolve_path(F.col("p"), rules), p="/a/b/a/b") == "/x/a/b"
    assert one(spark, S.resolve_path(F.col("p"), rules), p="/a/c") == "/y/c"
    assert one(spark, S.resolve_path(F.col("p"), rules, enabled=False), p="/a/c") == "/a/c"
    drives = [("m:", "\\\\nas\\m")]
    assert one(spark, S.resolve_drive(F.col("p"), drives), p="M:\\f\\M:x") == "\\\\nas\\m\\f\\M:x"
    assert one(spark, S.resolve_drive(F.col("p"), drives), p="/f") == "/f"
    items = spark.createDataFrame([(1, "/a/b/c"), (2, "/a/z"), (3, "/q")], "item_id long, path string")
    table = spark.createDataFrame([(2, "/a", "/y"), (1, "/a/b", "/x")], "ordinal int, prefix string, replacement string")
    assert {r.item_id: r.resolved for r in S.resolve_by_table(items, table).collect()} == {1: "/x/c", 2: "/y/z", 3: "/q"}


def test_names_files_and_draws(spark):
    assert one(spark, S.display_name(F.col("b"), F.col("o")), b="Discover", o=1) == "Discover\u200b\u200b"
    assert one(spark, S.file_action(F.col("e"), F.lit(True)), e="MKV") == "link"
    assert one(spark, S.file_action(F.col("e"), F.lit(False)), e="mkv") == "strm"
    assert one(spark, S.file_action(F.col("e"), F.lit(False)), e="nfo") == "copy"
    assert one(spark, S.file_action(F.col("e"), F.lit(False)), e="txt") is None
    draws = [r.x for r in spark.range(500).select(S.uniform(1, 0, F.col("id")).alias("x")).collect()]
    assert 0 <= min(draws) < 0.05 and 0.95 < max(draws) < 1
    assert draws != [r.x for r in spark.range(500).select(S.uniform(1, 1, F.col("id")).alias("x")).collect()]


def test_rules_of_many_prefix_lengths(spark):
    rules = spark.createDataFrame([(n, "/" + "a" * n, "/%d" % n) for n in range(1200, 0, -1)], "ordinal int, prefix string, replacement string")
    items = spark.createDataFrame([(n, "/" + "a" * n + "/x") for n in range(1, 1201, 7)] + [(0, "/b"), (-1, None)], "item_id int, path string")
    got = {r.item_id: r.resolved for r in S.resolve_by_table(items, rules.where("ordinal = 1 OR ordinal > 100")).collect()}
    assert got.pop(0) == "/b" and got.pop(-1) is None
    assert got == {n: "/1" + "a" * (n - 1) + "/x" for n in range(1, 1201, 7)}
    last = S.resolve_by_table(items, rules.withColumn("ordinal", -rules["ordinal"])).collect()
    assert {r.item_id: r.resolved for r in last if r.item_id > 0} == {n: "/%d/x" % n for n in range(1, 1201, 7)}
