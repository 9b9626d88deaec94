import random
from collections import Counter
from math import floor

import pytest
from pyspark.sql import functions as F

from marquee.llm import hard_negatives
from marquee.llm.hard_negatives import hard_negatives as mine

SCHEMA = "vec_id long, label int, embedding array<float>, anchor boolean"


def brute(rows, scale=256):
    whole = [(i, label, [floor(scale * x) for x in v], a) for i, label, v, a in rows if i is not None and label is not None and v is not None and all(x is not None and x == x and abs(x) != float("inf") for x in v)]
    out = []
    for n, (i, label, q, is_anchor) in enumerate(whole):
        if not is_anchor:
            continue
        scored = [(-sum(x * y for x, y in zip(q, r)), j, other) for m, (j, other, r, _) in enumerate(whole) if m != n and len(r) == len(q)]
        scored.sort()
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            fit = [(t, k) for t, k, other in scored if other != label and -50 * s <= -100 * t <= -95 * s][:3]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(fit, 1)]
    return Counter(out)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def made(n, dim, labels, seed, spread=1.0, hot=0):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = centres[rnd.randrange(6)]
        size = rnd.choice([0.2, 1.0, 1.0, 3.0])
        v = [size * (x + rnd.gauss(0, spread)) / dim**0.5 for x in c]
        if i < hot:
            v = [0.125] * dim
        rows.append((i, 1 if i < hot else rnd.randrange(labels), v, i % 10 == 0))
    rnd.shuffle(rows)
    return [(i, label, [float(f"{x:.6f}") for x in v], a) for i, label, v, a in rows]


def checked(spark, rows, **more):
    df = table(spark, rows)
    exact = [(r.vec_id, r.label, r.embedding, r.anchor) for r in df.collect()]  # as floats of 32 bits
    assert Counter(tuple(r) for r in mine(df, **more).collect()) == brute(exact)


@pytest.mark.parametrize("dim, spread, hot", [(8, 0.3, 0), (24, 1.0, 200), (3, 0.05, 0)])
def test_all_rows_against_brute_force(spark, monkeypatch, dim, spread, hot):
    monkeypatch.setattr(hard_negatives, "BUCKET_ROWS", 64)  # several buckets a task: the least scores rise, and ranges prune
    checked(spark, made(600, dim, 4, dim, spread, hot), pass_anchors=25)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = made(120, 4, 3, 2) + [(0, 1, [0.5, 0.25, 0.0, 0.0], True), (0, 1, [0.5, 0.25, 0.0, 0.0], True), (None, 1, [1.0] * 4, True), (500, None, [1.0] * 4, True), (501, 1, None, True), (502, 1, [1.0, None, 0.0, 0.0], True), (503, 1, [nan, 0.0, 0.0, 0.0], True), (504, 1, [inf, 0.0, 0.0, 0.0], True)]
    rows += [(600 + i, i % 2, [0.5, 0.5], i == 0) for i in range(8)] + [(700 + i, i % 2, [], i == 0) for i in range(4)] + [(800, 1, [0.0] * 4, True), (801, 2, [-1.0] * 4, None), (802, 77, [1.0] * 4, True)]
    checked(spark, rows)
    assert mine(table(spark, rows).limit(0)).collect() == []
    assert mine(table(spark, rows).withColumn("anchor", F.lit(False))).collect() == []
    clashing = table(spark, rows).withColumns({"q": F.lit("x"), "length": F.lit(1), "rank": F.lit(2)})
    assert Counter(tuple(r) for r in mine(clashing).collect()) == Counter(tuple(r) for r in mine(table(spark, rows)).collect())
    with pytest.raises(ValueError, match="exact range"):
        mine(table(spark, [(1, 1, [3.0e38, 1.0], True)]))
    checked(spark, [(i, i % 3, [200.0 * ((7 * i) % 11), -90.5 * (i % 5), 1000.25], i % 4 == 0) for i in range(60)])  # beyond 16 bits a component


def test_ranges_prune():
    import numpy as np

    rng = np.random.default_rng(3)
    q = rng.integers(-200, 200, (50, 8))
    p = rng.integers(-200, 200, (5000, 8))
    size, length = np.sqrt((q.astype(float) ** 2).sum(1)), float(np.sqrt((p.astype(float) ** 2).sum(1).max()))
    focus = np.argsort(-np.abs(q), axis=1)[:, :3]
    least = 0.8 * size * length
    low, high = hard_negatives._ranges(q.astype(float), size, focus, least, length)
    inside = np.ones((50, 5000), bool)
    for j in range(3):
        v = p[:, focus[:, j]].T
        inside &= (v >= low[:, j, None]) & (v <= high[:, j, None])
    assert not ((q @ p.T >= least[:, None]) & ~inside).any()  # no row that reaches the score is left out
    assert inside.mean() < 0.4
