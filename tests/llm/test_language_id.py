import itertools
import random
import zlib

import numpy as np

from marquee.llm import language_id as G
from marquee.llm.crf import CRF


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    model = CRF(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    sizes = [1, 0, 4, 6]
    before = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(size=(sum(sizes), 3)).astype(np.float32)
    got, pairs = model.posteriors(scores, before, pairs=True)
    want, want_pairs = np.zeros_like(got), np.zeros((3, 3))
    for a, b in zip(before[:-1], before[1:]):
        if a == b:
            continue
        total, own, own_pairs = 0.0, np.zeros((b - a, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=b - a):
            p = np.exp(model.start[path[0]] + sum(float(scores[a + k, y]) for k, y in enumerate(path)) + sum(model.transitions[x, y] for x, y in zip(path, path[1:])))
            total += p
            for k, y in enumerate(path):
                own[k, y] += p
            for x, y in zip(path, path[1:]):
                own_pairs[x, y] += p
        want[a:b] = own / total
        want_pairs += own_pairs / total
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_blocks_of_a_long_text_agree_with_one_pass():
    rng = np.random.default_rng(4)
    model = CRF(["a", "b"], np.zeros((1, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    scores = rng.normal(size=(1000, 2)).astype(np.float32)
    got = model.posteriors(scores, np.array([0, 1, 700, 1000]))
    for a, b in ((0, 1), (1, 700), (700, 1000)):
        e, t = np.exp(scores[a:b].astype(float)), np.exp(model.transitions)
        f, w = np.zeros((b - a, 2)), np.ones((b - a, 2))
        for k in range(b - a):
            f[k] = (np.exp(model.start) if k == 0 else f[k - 1] @ t) * e[k]
            f[k] /= f[k].sum()
        for k in range(b - a - 2, -1, -1):
            w[k] = t @ (w[k + 1] * e[k + 1])
            w[k] /= w[k].sum()
        want = f * w / (f * w).sum(axis=1, keepdims=True)
        assert np.allclose(got[a:b], want)


def made():
    rnd = random.Random(1)
    syllables = {"xx": ["ka", "to", "mi", "ré"], "yy": ["sch", "ung", "ter", "öl"], "zz": ["tion", "ly", "the", "ka"]}
    text = lambda lang, n: " ".join("".join(rnd.choice(syllables[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))
    rows = [(i, text(lang, rnd.randrange(5, 80)).capitalize() + ".", lang) for i, lang in enumerate(rnd.choices(sorted(syllables), [6, 3, 1], k=400))]
    return rows, text


def test_held_out_accuracy_and_edges(spark):
    rows, text = made()
    edges = [(1000, None, "xx"), (1001, "", None), (1002, " 12 € ! ", "yy"), (1003, text("yy", 20), None), (None, text("zz", 30), "xx"), (1004, "q " * 3000, None), (1004, "q " * 3000, None)]
    docs = spark.createDataFrame([(i, t, g, 0.5) for i, t, g in rows + edges], "doc_id long, text string, lang string, score double")
    model = G.learn(docs)
    assert model.labels == ["xx", "yy", "zz"]
    got = G.predict(docs, model).collect()
    assert len(got) == len(rows) + len(edges) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    held = [(i, g) for i, _, g in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(by[i].lang_pred == g for i, g in held) / len(held) > 0.97
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1002].score == 0
    assert by[1003].lang_pred == "yy" and by[None].lang_pred == "zz"
    flags = {r.doc_id: r.h for r in docs.select("doc_id", G.held_out("doc_id").alias("h")).collect()}
    assert all(flags[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows) and flags[None]


def test_words_of_switched_text(spark):
    rows, text = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = G.learn(docs)
    a, b = text("yy", 15), text("zz", 15)
    mixed = spark.createDataFrame([(1, a + " " + b)], "doc_id long, text string")
    words = G.label_words(mixed, model).first().words
    assert len(words) == 30
    assert sum(w.lang == ("yy" if k < 15 else "zz") for k, w in enumerate(words)) >= 26


def test_a_language_of_long_texts_only_is_learned(spark):
    rows, text = made()
    long = [(2000 + i, text(lang, 120), lang) for i, lang in enumerate(["yy", "zz"] * 40)]
    rows = [r for r in rows if r[2] == "xx"] + long
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for texts, longest in ((300, 500), (3, 500), (1, 100)):  # all, some, and a part of one of the long texts
        model = G.learn(docs, texts, longest)
        assert model.labels == ["xx", "yy", "zz"]
    got = {r.doc_id: r.lang_pred for r in G.predict(docs, G.learn(docs, 300, 500)).collect()}
    assert sum(got[i] == lang for i, _, lang in long) >= 0.97 * len(long)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert G.predict(none, G.learn(none)).count() == 0
    one = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert G.predict(one, G.learn(one)).first().lang_pred == "und"
