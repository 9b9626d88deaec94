import os
import random

import pytest
from pyspark.sql import functions as F

from marquee.sources import log_files, readers


@pytest.fixture
def small_splits(spark):
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "4k")
    yield spark
    spark.conf.set(setting, before)


def numbered(df):
    return sorted((r.file, r.line_no, r.line) for r in df.select("file", "line_no", "line").collect())


def test_numbers_across_splits(small_splits, tmp_path):
    spark, rnd = small_splits, random.Random(3)
    expected = []
    for name, lines, end in (("a.log", 3000, "\n"), ("b.log", 700, ""), ("c.log", 1, "\n"), ("d.log", 0, ""), ("e.log", 40, "\r\n"), ("long.log", 9, "\n")):
        own = ["é" * rnd.choice([0, 1, 5, 60]) + f" line {i}" * rnd.randrange(3) for i in range(lines)]
        if name == "long.log":
            own[3:5] = ["x" * 30_000, ""]  # a line over many splits
        if own and not end:
            own[-1] = "the end"
        sep = "\r\n" if end == "\r\n" else "\n"
        (tmp_path / name).write_bytes((sep.join(own) + end).encode() if own else b"")
        expected += [(name, i, line) for i, line in enumerate(own)]
    (tmp_path / "other.txt").write_text("no")
    found = readers.read_logs(spark, str(tmp_path))
    assert numbered(found) == sorted(expected)
    parts = spark.read.option("pathGlobFilter", "a.log").option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions()
    assert parts > 10  # one file in many tasks
    (tmp_path / "blank.log").write_text("\n")
    assert ("blank.log", 0, "") in numbered(readers.read_logs(spark, str(tmp_path)))


def test_tail_reads_the_end_only(spark, tmp_path):
    read = {}
    for n in (2_000, 200_000):
        (tmp_path / "big.log").write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(n)))
        rows = log_files.read_tail(spark, str(tmp_path), 100, block_bytes=2048).orderBy("from_end").collect()
        assert [r.line for r in rows] == [f"line {i} {'x' * (i % 50)}" for i in range(n - 1, n - 101, -1)] and [r.from_end for r in rows] == list(range(1, 101))
        read[n] = rows[0].bytes_read
    assert max(read.values()) < 20_000 < os.path.getsize(tmp_path / "big.log") / 100
    assert read[200_000] <= read[2_000]  # it doesn't grow with the file


def test_tail_edges(spark, tmp_path):
    texts = {"none.log": b"", "one.log": b"only", "end.log": b"a\r\nb\r\n", "blank.log": b"\n\n\n", "long.log": b"first\n" + b"y" * 50_000 + b"\nlast", "bad.log": b"\xff\xfe\n", "no.txt": b"z\n"}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in log_files.read_tail(spark, str(tmp_path), 2, block_bytes=16).orderBy("file", F.desc("from_end")).collect():
        got.setdefault(r.file, []).append(r.line)
    assert got == {"one.log": ["only"], "end.log": ["a", "b"], "blank.log": ["", ""], "long.log": ["y" * 50_000, "last"], "bad.log": ["��"]}
    os.utime(tmp_path / "end.log", (4e9, 4e9))
    os.utime(tmp_path / "one.log", (4e9, 4e9))
    assert {r.file for r in log_files.read_tail(spark, str(tmp_path), latest=True).collect()} == {"one.log"}  # ties: the last by name
    assert log_files.read_tail(spark, f"file://{tmp_path}/end.log").count() == 2
    assert log_files.read_tail(spark, str(tmp_path / "missing")).count() == 0
    # the same as the tail of all lines
    lines = readers.read_logs(spark, str(tmp_path)).where("file = 'long.log'").orderBy(F.desc("line_no")).limit(2).collect()
    assert [r.line for r in lines] == got["long.log"][::-1]
