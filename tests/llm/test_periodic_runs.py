import hashlib
import random
import re
import zlib

import numpy as np

from marquee.llm import periodic_runs
from marquee.llm.queries import QUERIES, with_planted_periods


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(w):
    """(start, length, period) of all runs, by comparing words at every distance."""
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and (i, j + q) not in out:
                out[i, j + q] = q
            i = max(j, i) + 1
    return sorted((a, b - a, q) for (a, b), q in out.items())


def kept(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def made(rnd):
    letters, out = rnd.choice([1, 2, 2, 3, 4, 10]), []
    for _ in range(rnd.randrange(8)):
        if rnd.random() < 0.4:
            out += [rnd.randrange(letters) for _ in range(rnd.randrange(30))]
        else:
            base = [rnd.randrange(letters) for _ in range(rnd.randrange(1, 24))]
            out += (base * rnd.randrange(1, 12))[: rnd.randrange(1, 200)]
    return [f"w{x}é" for x in out]


def test_all_runs_of_random_words():
    rnd = random.Random(5)
    for _ in range(400):
        docs = [made(rnd) for _ in range(rnd.randrange(1, 6))]
        ids = {w: i for i, w in enumerate(sorted({w for d in docs for w in d}))}
        offsets = np.append(0, np.cumsum([len(d) for d in docs])).astype(np.int64)
        found = periodic_runs._found(np.array([ids[w] for d in docs for w in d], np.int64), offsets)
        assert found == sorted((a + o, a + n + o, q) for d, o in zip(docs, offsets.tolist()) for a, n, q in brute(d))


def test_runs_and_edges(spark):
    rnd = random.Random(11)
    long = [f"v{rnd.randrange(5000)}" for _ in range(150_000)] + ["a", "b", "c"] * 30_000 + ["x"] * 7 + [f"u{i % 70_000}" for i in range(300_000)]
    rows = [(i, " \t\x0b".join(made(rnd)) + "\r\n") for i in range(200)]
    rows += [(None, "a a a a a a"), (3, "b c b c b c b c"), (3, "b c b c b c b c"), (300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "           "), (305, " ".join(long))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, runs string, n_words int").repartition(3)
    found = periodic_runs.periodic_runs(docs)
    got = sorted(((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in found.collect()), key=repr)
    expected = []
    for i, t in rows:
        w = words_of(t)
        runs = brute(w) if i != 305 else [(150_000, 90_000, 3), (240_000, 7, 1), (240_007, 300_000, 70_000)]
        expected.append((i, len(w), tuple(runs), kept(w, runs)))
    assert got == sorted(expected, key=repr)
    assert len(long) * 4 > 1 << 20  # longer than a piece
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    assert "Exchange" not in periodic_runs.periodic_runs(docs.sparkSession.range(9).selectExpr("id AS doc_id", "'a' AS text"))._jdf.queryExecution().executedPlan().toString()


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_against_brute_force(spark, tmp_path):
    rnd = random.Random(7)
    rows = [(i, " ".join(f"w{rnd.randrange(9)}" for _ in range(rnd.randrange(120)))) for i in range(400)] + [(None, "a b"), (901, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected, n_planted = [], 0
    for i, t in rows:
        w = planted(i, words_of(t)) if i is not None else words_of(t)
        n_planted += w != words_of(t)
        runs = brute(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        expected.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{a},{n},{q}\n" for a, n, q in runs)), digest(kept(w, runs))))
    assert n_planted > 10
    got = [tuple(r) for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    changed = {r.doc_id: r.text for r in with_planted_periods(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert all(words_of(changed[i]) == planted(i, words_of(t)) for i, t in rows if i is not None)
