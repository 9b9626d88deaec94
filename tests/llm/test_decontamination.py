import hashlib
import random
import re

import numpy as np

from marquee.llm import decontamination as D
from marquee.llm import queries as Q
from marquee.llm.fm_index import FMIndex, suffix_array

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return PATTERN.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for a in range(max(len(w) - 12, 1)):
                windows.setdefault(tuple(w[a : a + 13]), set()).add(str(i))
    out = []
    for _, t in docs:
        w = words(t)
        hit, found = set(), set()
        for p, who in windows.items():
            for a in range(len(w) - len(p) + 1):
                if tuple(w[a : a + len(p)]) == p:
                    hit |= set(range(a, a + len(p)))
                    found |= who
        out.append((len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_fm_index():
    rng = np.random.default_rng(2)
    runs = [rng.integers(1, 4, k) for k in (1, 30, 7, 200, 2)] + [np.array([1, 2] * 60)]
    flat = np.concatenate(runs)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    index = FMIndex(flat, offsets, 5)
    for k in (1, 2, 3, 6):
        for _ in range(20):
            p = rng.integers(1, 5, k)
            table = np.zeros((1, 8), np.int64)
            table[0, 8 - k :] = p
            low, high = index.ranges(table, np.array([k]))
            got = sorted(index.locate(np.arange(low[0], high[0])).tolist()) if low[0] < high[0] else []
            want = [int(o) + a for r, o in zip(runs, offsets) for a in range(len(r) - k + 1) if (r[a : a + k] == p).all()]
            assert got == want
    s = np.array([3, 1, 3, 1, 3, 0])
    assert suffix_array(s).tolist() == sorted(range(6), key=lambda i: s[i:].tolist())


def test_equals_brute_force(spark):
    rnd = random.Random(8)
    vocabulary = ["the", "Of", "é", "x1", "ÀB", "to", "in9"] + ["w%d" % i for i in range(40)]
    text = lambda k: rnd.choice([" ", ", ", "-", "\n"]).join(rnd.choice(vocabulary) for _ in range(k))
    items = [(i, text(rnd.choice([1 if i == 0 else 4, 13, 14, 40]))) for i in range(20)] + [(20, None), (21, ""), (None, "the the the"), (3, "a b c d e f g h i j k l m n"), (22, "unique-short phrase")]
    docs = []
    for i in range(60):
        parts = [text(rnd.randrange(0, 60))]
        for _ in range(rnd.randrange(0, 3)):
            w = words(rnd.choice(items)[1])
            a = rnd.randrange(0, 4)
            parts += [" ".join(w[a : a + rnd.randrange(5, 40)]).upper(), "zzz" if rnd.random() < 0.5 else "", text(rnd.randrange(0, 9))]
        docs.append((i, " ".join(parts)))
    docs += [(60, None), (61, ""), (62, "!!!"), (5, "the the the unique short phrase"), (None, text(30))]
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    want = sorted(((-1 if d[0] is None else d[0], *w) for d, w in zip(docs, brute(docs, items))), key=str)
    for size in (1 << 20, 150):  # one block, and many
        got = D.contamination(table, bench, block_bytes=size).collect()
        assert sorted(((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got), key=str) == want
        raw = {r.doc_id: r for r in got}
        for i, t in docs[:60]:
            for s in raw[i].spans if i != 5 else []:  # that id is repeated
                assert len(words(t.encode()[s["from"] : s["to"]].decode())) == s["end_word"] - s["word"]
                assert words(t)[s["word"] : s["end_word"]] == words(t.encode()[s["from"] : s["to"]].decode())


def test_items_without_id_hit(spark, tmp_path):
    docs = [(1, "so The cat SAT down"), (2, "the cat sat, a dog ran"), (3, "a dog ran"), (4, "none")]
    items = [(None, "the cat sat"), (7, "a dog ran"), (None, "cat sat down"), (8, None), (None, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table, bench = (spark.read.parquet(f"{tmp_path}/{name}.parquet") for name in ("documents", "benchmark"))
    want = {1: (4, 1, [None], True), 2: (6, 2, ["7", None], True), 3: (3, 1, ["7"], True), 4: (0, 0, [], False)}
    for size in (1 << 20, 5):
        got = D.contamination(table, bench, block_bytes=size, unnamed=True).collect()
        assert {r.doc_id: (r.n_hit, r.n_items, r.item_ids, r.contaminated) for r in got} == want
    # what the query's SQL gives: string_agg leaves out nulls, count(*) doesn't
    rows = {r.doc_id: r for r in Q.QUERIES["op7_decontamination"](spark, str(tmp_path)).collect()}
    assert {i: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for i, r in rows.items()} == {i: (h, n, hashlib.sha256(",".join(x for x in s if x).encode()).hexdigest(), c) for i, (h, n, s, c) in want.items()}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(none, items).count() == 0
    one = D.contamination(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items).first()
    assert (one.n_words, one.n_hit, one.n_items, one.contaminated) == (2, 0, 0, False)


def test_fifty_blocks_take_one_worker_a_task(spark):
    """Each pass is written and its broadcast destroyed, so that neither plans nor workers pile up."""
    items = spark.createDataFrame([(i, f"needle{i} thread{i} pin{i}") for i in range(50)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"so needle{i % 60} thread{i % 60} pin{i % 60} needle{(i + 1) % 60} thread{(i + 1) % 60} pin{(i + 1) % 60} end") for i in range(120)], "doc_id long, text string")
    found = D.contamination(docs, items, block_bytes=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 2
    one = D.contamination(docs, items)
    assert one._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(repr, found.collect())) == sorted(map(repr, one.collect()))


def test_texts_beyond_a_piece(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    filler = "word " * 150_000
    docs = spark.createDataFrame([(1, filler + passage + " " + filler + passage), (2, filler)], "doc_id long, text string")
    items = spark.createDataFrame([(5, passage), (6, "nowhere to be found")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids, [s["word"] for s in r.spans]) for r in D.contamination(docs, items).collect()}
    assert got == {1: (300_026, 26, ["5"], [150_000, 300_013]), 2: (150_000, 0, [], [])}
