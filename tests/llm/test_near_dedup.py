import random
import re
from collections import defaultdict

import pytest

from marquee.llm import lsh_forest
from marquee.llm.components import components


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute(rows):
    """(doc_id -> component) by comparing all pairs that share a shingle."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(k)
    seen = set()
    for k, (i, s) in enumerate(sets):
        for m in {m for x in s for m in by[x] if m > k}:
            j, r = sets[m]
            both = len(s & r)
            if (i, j) not in seen and 100 * both >= 75 * (len(s) + len(r) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in parent}


def made(seed=3):
    rnd = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    rows = []
    for group in range(30):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([6, 40, 200]))]
        for _ in range(rnd.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rnd.randrange(0, max(2, len(base) // 25))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    template = [rnd.choice(vocabulary) for _ in range(60)]
    for _ in range(40):  # letters of one form: alike, but mostly not linked
        rows.append((len(rows), " ".join(template + [rnd.choice(vocabulary) for _ in range(rnd.randrange(8, 30))])))
    base = [rnd.choice(vocabulary) for _ in range(150)]  # one original with many edited copies, about the limit
    for _ in range(120):
        copy = list(base)
        for _ in range(rnd.randrange(0, 9)):
            copy[rnd.randrange(len(copy))] = "new%d" % rnd.randrange(10**6) if rnd.random() < 0.7 else rnd.choice(vocabulary)
        rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n"), (len(rows) + 3, "one two"), (len(rows) + 4, "ONE  two"), (len(rows) + 5, "one two three"), (None, "one two")]
    rows.append((0, rows[40][1]))  # a repeated id with another text links both
    return rows


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_near_dedup_equals_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, signature string")
    got = lsh_forest.near_dedup(docs).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)
    sizes = defaultdict(set)
    for i, t in rows:
        sizes[i].add(len(shingles(t)))
    assert all(r.n_shingles in sizes[r.doc_id] for r in got)


def test_a_hot_region_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "LEAF", 2)
    rows = [r for r in made(9) if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert all(r.component_id == want[r.doc_id] for r in lsh_forest.near_dedup(docs).collect())


def test_texts_of_one_document_are_linked(spark):
    a, b, c = ("%s one two three four five six" % x for x in "abc")
    long = " ".join("w%d" % i for i in range(200_000))  # beyond a piece
    rows = [(5, a), (5, b), (3, a), (4, b), (6, c), (7, c), (8, "x y"), (8, "z"), (9, long), (1, long + " end"), (None, a)]
    got = lsh_forest.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got if r.doc_id) == [(1, 1), (3, 3), (4, 3), (5, 3), (5, 3), (6, 6), (7, 6), (8, 8), (8, 8), (9, 1)]


def test_empty(spark):
    assert lsh_forest.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_beyond_a_piece(spark):
    rnd = random.Random(1)
    words = [f"w{rnd.randrange(60_000)}" for _ in range(220_000)]
    near = list(words)
    for i in range(0, len(near), 400):
        near[i] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[::-1])), (4, " ".join(words).upper())]
    assert all(len(t) > 1 << 20 for _, t in rows)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in lsh_forest.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (3 if i == 3 else 1, len(shingles(t))) for i, t in rows}


def test_only_shingles_that_texts_outside_add_meet(spark):
    """A row for each shingle that any of many copies adds was made, though pairs need a text outside the pivot's component."""
    rnd = random.Random(3)
    hashes = lambda n: [rnd.getrandbits(64) - 2**63 for _ in range(n)]
    common, own = hashes(2), hashes(20)
    rows = [(i, 1, False, common + own[:1] * (i == 5) + hashes(30)) for i in range(500)] + [(900, 1, True, common + own), (901, 1, True, [])]
    got = {r.id: r.met for r in lsh_forest._met(spark.createDataFrame(rows, "id long, main long, outside boolean, added array<long>")).collect()}
    assert len(got) == len(rows) and got[900] == common + own and got[901] == []
    assert all(set(common) <= set(got[i]) for i in range(500)) and own[0] in got[5]
    assert sum(map(len, got.values())) < 1500  # of 16,021


def test_shingles_are_counted_of_texts_that_add_many_only(spark):
    """Each text had a row for each shingle it adds, though a bit map tells those apart that add few."""
    rnd = random.Random(4)
    hashes = lambda n: [rnd.getrandbits(64) - 2**63 for _ in range(n)]
    common, many = hashes(3), lsh_forest.CROWDED
    few = [(i, 1, True, common + hashes(many - 3)) for i in range(200)]
    rows = few + [(900, 1, True, common + hashes(many)), (901, 1, False, common[:2] + hashes(many)), (902, 1, False, few[0][3] + hashes(1))]
    got = {r.id: r.shared for r in lsh_forest._shared(spark.createDataFrame(rows, "id long, main long, outside boolean, added array<long>")).collect()}
    assert set(got) == {900, 901, 902}  # no text of `few`
    assert got[900] == 3 and 2 <= got[901] <= 10 and 3 <= got[902] <= 10


def test_texts_that_add_few_and_many_are_linked(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "LEAF", 2)
    monkeypatch.setattr(lsh_forest, "CROWDED", 3)
    rows = [r for r in made(11) if r[0] is not None]
    want = brute(rows)
    assert all(r.component_id == want[r.doc_id] for r in lsh_forest.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
