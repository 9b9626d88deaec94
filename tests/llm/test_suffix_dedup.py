import random

import numpy as np

from marquee.llm import suffix_dedup as S


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for i, b in enumerate(raw):
        for p in range(len(b) - 399):
            seen.setdefault(b[p : p + 400], []).append((i, p))
    cover = [np.zeros(len(b), bool) for b in raw]
    for where in seen.values():
        if len(where) > 1:
            for i, p in where:
                cover[i][p : p + 400] = True
    out = []
    for b, c in zip(raw, cover):
        edges = np.flatnonzero(np.diff(np.r_[0, c.astype(np.int8), 0]))
        out.append((len(b), [(int(x), int(y)) for x, y in zip(edges[::2], edges[1::2])], bytes(np.frombuffer(b, np.uint8)[~c]) if len(b) else b""))
    return out


def made(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeéñ") for _ in range(rnd.randrange(1, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(rnd.choice([60, 75, 90, 200])) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [text(rnd.randrange(0, 60))]
        for _ in range(rnd.randrange(0, 3)):
            s = rnd.choice(shared)
            a = rnd.randrange(0, 60)
            parts += [s[a : len(s) - rnd.randrange(0, 60)], text(rnd.randrange(0, 30))]
        texts.append(" ".join(parts))
    base = text(300)
    for _ in range(40):  # near copies
        b = list(base)
        for _ in range(rnd.randrange(0, 4)):
            b[rnd.randrange(len(b))] = rnd.choice("xyz")
        texts.append("".join(b))
    texts += [None, "", "a" * 399, "a" * 400, "a" * 900, "ab" * 450, "ba" * 450, "x" * 401, base, base, " ".join(["THE!!"] * 200)]
    return texts


def compare(spark, texts):
    rows = [(i if i % 7 else None if i == 0 else i, t, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place int").repartition(3)
    got = S.substring_dedup(docs).collect()
    want = brute(texts)
    key = lambda r: (-1 if r[0] is None else r[0], r[1])
    mine = sorted(((r.doc_id, r.n_bytes, [(s["from"], s["to"]) for s in r.spans], bytes(r.kept_bytes)) for r in got), key=key)
    theirs = sorted(((d, *w) for (d, _, _), w in zip(rows, want)), key=key)
    assert mine == theirs


def test_equals_brute_force(spark):
    compare(spark, made(1))


def test_a_hot_core_over_many_partitions(spark):
    """One passage in very many texts, each with other surroundings: its phrases' intervals go on over partitions."""
    rnd = random.Random(3)
    letters = lambda k: "".join(rnd.choice("abcdefgh") for _ in range(k))
    center, texts = letters(700), []
    for _ in range(150):
        a, b = rnd.randrange(0, 330), rnd.randrange(360, 700)
        texts.append(letters(rnd.randrange(0, 300)) + center[a:b] + rnd.choice([letters(rnd.randrange(0, 300)), ""]))
    for _ in range(60):
        edited = list(center)
        for _ in range(rnd.randrange(0, 3)):
            edited[rnd.randrange(len(edited))] = rnd.choice("xyz")
        texts.append("".join(edited))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("3", "41"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            compare(spark, texts)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)


def test_a_text_beyond_a_piece(spark):
    rnd = random.Random(6)
    long = "".join(rnd.choice("abcdefgh") for _ in range(1_100_000))
    compare(spark, [long, "x" + long[5000:6000], long[700_000:700_399], "q" * 500, None])


def test_intervals_equal_brute_force():
    rnd = random.Random(4)
    for floor in (-1, 1):
        rows = sorted({("" if floor < 0 else "zz") + "".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 9))) for _ in range(60)})
        rows = [r.encode() for r in rows]
        common = [floor, *S._common(rows, 16).tolist()]
        want = {}
        for n in range(floor + 1, 12):
            groups = {}
            for i, r in enumerate(rows):
                if len(r) >= n:
                    groups.setdefault(r[:n], []).append(i)
            for g in groups.values():
                if len(g) > 1:
                    want.setdefault((g[0], g[-1] + 1), []).append(n)
        got = {(a, b): list(range(low + 1, high + 1)) for low, high, a, b in S.intervals(common, floor)}
        assert got == want


def test_empty(spark):
    assert S.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
