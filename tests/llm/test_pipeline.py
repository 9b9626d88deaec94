import importlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from marquee.llm.store import written

from .test_decontamination import brute as contaminated
from .test_language_id import made
from .test_line_dedup import brute as cut_lines
from .test_near_dedup import brute as groups

sentencepiece = pytest.importorskip("sentencepiece")


def test_stages_equal_brute_force(spark, tmp_path):
    rows, text = made()
    passage = " ".join("ka%d" % i for i in range(30))
    rows = [(i, t, g, "s", len(t)) for i, t, g in rows]
    extra = [
        (500, "123 !!!", "xx"), (501, None, None), (502, rows[3][1], "xx"), (503, rows[3][1] + " ka", "xx"),
        (504, "tomi kato\nmika toka\n" + text("xx", 30), "xx"), (505, text("xx", 20) + "\ntomi kato\nmika toka", "xx"), (506, "tomi kato\nmika toka", "xx"),
        (507, text("xx", 9) + " " + passage.upper(), "xx"), (508, text("yy", 40) + " " + " ".join(passage.split()[:12]), "yy"),
    ]
    rows += [(i, t, g, "s", len(t or "")) for i, t, g in extra]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in P.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = written(stage(spark, docs, str(tmp_path)), "stage")
        kept.append({r.doc_id: r.asDict() for r in docs.collect()})
        if name != P.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language ID":
            assert {i for i, _ in before} - set(kept[-1]) >= {500, 501} and len(kept[-1]) >= 0.98 * len(before) - 2
        elif name == "line dedup":
            want = {i: t for i, (t, n, gone, _) in cut_lines(before, 2, 50).items() if not gone or gone < n}
            assert {i: r["text"] for i, r in kept[-1].items()} == want and 506 not in want
            assert all(r["n_chars"] == len(r["text"]) for r in kept[-1].values())
        elif name == "near dedup":
            assert set(kept[-1]) == {i for i, c in groups(before).items() if i == c}
        elif name == "decontamination":
            found = contaminated(before, [(1, passage)])
            assert set(kept[-1]) == {i for (i, _), f in zip(before, found) if not f[3]} and 507 not in kept[-1]
    assert len(kept[-1]) == len(kept[-2]) and all(r["round_trip"] and r["parity"] for r in kept[-1].values())
    assert {r.doc_id for r in P.run(spark, str(tmp_path)).collect()} == set(kept[-1])


def test_repeated_and_null_ids_have_decisions_of_their_own(spark, tmp_path):
    rows, text = made()
    passage = " ".join("ka%d" % i for i in range(30))
    long = [text("xx", 60) for _ in range(4)]
    clear = {x: (i, x) for x, i in zip(long, (700, 700, None, 701))}
    extra = [
        *clear.values(),
        (700, "123 !!!"), (None, "456 ???"),  # no language
        (702, "tomi kato\nmika toka\n" + text("xx", 30)), (703, "tomi kato\nmika toka"), (703, text("xx", 50)), (None, "tomi kato\nmika toka\n" + text("xx", 40)),  # repeated lines; null ids come first
        (701, long[0] + " ka"), (None, long[3] + " ka"), (None, long[2]),  # near copies
        (701, text("xx", 9) + " " + passage), (None, text("xx", 8) + " " + passage),  # contaminated
    ]
    table = [(i, t, g, "s", len(t)) for i, t, g in rows] + [(i, t, "xx", "s", len(t)) for i, t in extra]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), "stage")
        left.append([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is None or r.doc_id >= 700])
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(left[0], key=key) == sorted((r for r in extra if "!" not in r[1] and "?" not in r[1]), key=key)
    cut = [(i, t.removeprefix("tomi kato\nmika toka\n") if i == 702 else t) for i, t in left[0] if (i, t) != (703, "tomi kato\nmika toka")]
    assert sorted(left[1], key=key) == sorted(cut, key=key)
    copies = [(701, long[0] + " ka"), (None, long[3] + " ka"), (None, long[2])]
    for c in copies:
        cut.remove(c)
    assert sorted(left[2], key=key) == sorted(cut, key=key) and set(clear.values()) <= set(left[2])
    assert sorted(left[3], key=key) == sorted((r for r in cut if passage not in r[1]), key=key)


def test_empty_tables_clashing_columns_and_long_texts(spark, tmp_path):
    rows, text = made()
    long = text("xx", 230_000)
    clash = {c: "kept" for c in ("others", "row", "key1", "id", "tie", "row_no", "n_removed", "kept_text", "n_lines", "component_id", "lang_pred", "score", "contaminated", "letters", "part")}
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clash)
    table = [(i, t, g, "s", len(t), *clash.values()) for i, t, g in [*rows[:60], (900, long, "xx"), (901, long, "xx")]]
    spark.createDataFrame([(1, "ka ke ki")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for own in (table, []):
        folder = tmp_path / str(len(own))
        spark.createDataFrame(own, kind).write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        assert len(long.encode()) > 1 << 20  # more than the pieces that tasks work on
        for _, stage in P.STAGES[:-1]:
            docs = written(stage(spark, docs, str(folder)), "stage")
            assert docs.dtypes == spark.read.parquet(f"{folder}/documents.parquet").dtypes
        found = docs.collect()
        assert all(r[c] == "kept" for r in found for c in clash) and (not own or [r.text for r in found if r.doc_id >= 900] == [long])
        if not own:
            assert P.run(spark, str(folder)).collect() == []


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    assert "pipeline" in entry.queries() and {f"op{n}_" for n in range(1, 11)} <= {q.split("_")[0] + "_" for q in entry.queries()}
