import random

import pytest

from marquee.llm import line_dedup as L


def brute(docs, min_lines, long_words):
    seqs = [(i, [x.strip(" \t\r\x0b\x0c") for x in (t or "").split("\n")]) for i, t in docs]
    places = [(i, [x for x in s if x]) for i, s in seqs]
    first = {}
    for i, s in sorted(places, key=lambda p: p[0]):
        for a in range(len(s)):
            first.setdefault((s[a],), (i, a))
            if a + min_lines <= len(s):
                first.setdefault(tuple(s[a : a + min_lines]) if min_lines > 1 else ("run", s[a]), (i, a))
    out = {}
    for (i, s), (_, t) in zip(places, docs):
        gone = set()
        for a in range(len(s)):
            if len(s[a].split()) >= long_words and first[(s[a],)] != (i, a):
                gone.add(a)
            if a + min_lines <= len(s) and first[tuple(s[a : a + min_lines]) if min_lines > 1 else ("run", s[a])] != (i, a):
                gone |= set(range(a, a + min_lines))
        kept, n = [], 0
        for line in (t or "").split("\n"):
            if line.strip(" \t\r\x0b\x0c"):
                if n not in gone:
                    kept.append(line)
                n += 1
            else:
                kept.append(line)
        out[i] = ("\n".join(kept), len(s), len(gone), sum(g - 1 not in gone for g in gone))
    return out


@pytest.mark.parametrize("min_lines", [1, 2, 5])
def test_equals_brute_force(spark, min_lines):
    rnd = random.Random(min_lines)
    lines = ["line %d" % i for i in range(30)] + ["", "  ", "\t", " line 3 ", "é\r", "long " * 60]
    docs = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(0, 25)))) for i in range(50)]
    docs += [(50, docs[3][1]), (51, None), (52, ""), (53, "\n\n"), (54, "x\nx\nx\nx\nx"), (55, "x\nx\nx"), (56, "a" * 10000)]
    table = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, key string").repartition(3)
    got = {r.doc_id: (r.kept_text, r.n_lines, r.n_removed, r.n_runs) for r in L.line_dedup(table, min_lines).collect()}
    assert got == brute(docs, min_lines, 50)


def test_nulls_and_repeated_rows(spark):
    rows = [(None, "a\nb"), (1, "a\nb"), (2, "c\nd"), (2, "c\nd"), (3, "c\nd\ne")]
    got = L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.kept_text) for r in got) == [(0, "a\nb"), (1, ""), (2, "c\nd"), (2, "c\nd"), (3, "e")]
    assert L.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_array_equals_brute_force(spark):
    rnd = random.Random(11)
    texts = [[rnd.choice("abcde") for _ in range(rnd.randrange(0, 14))] for _ in range(12)] + [list("abcabcabcabc"), list("zabcabcabcabc"), ["q"] * 9, ["u", "v", "w"], list("abcabcabcabc")]
    rows = [(i, k, at, len(t), ord(x), 0, 1) for i, t in enumerate(texts) for k in [i * 7 % 17] for at, x in enumerate(t)]
    lines = spark.createDataFrame(rows, "doc_id long, key long, at long, size long, n1 long, n2 long, words long").repartition(3)
    got = sorted(L.suffix_array(lines).collect(), key=lambda r: r.pos)
    all_lines = [x for t in texts for x in t]
    shared = {x for x in all_lines if all_lines.count(x) > 1}
    assert {(r.doc_id, r.at) for r in got} == {(i, at) for i, t in enumerate(texts) for at, x in enumerate(t) if x in shared}
    assert [r.pos for r in got] == list(range(len(got)))
    common = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    suffix = [(r.doc_id, texts[r.doc_id][r.at :]) for r in got]
    for n, (r, (i, s)) in enumerate(zip(got, suffix)):
        assert r.lcp == (common(suffix[n - 1][1], s) if n else 0), (n, s)
        if n and r.lcp:
            a, b = texts[got[n - 1].doc_id], texts[i]
            p, q = got[n - 1].at, r.at
            assert r.maximal == (not (p and q and a[p - 1] == b[q - 1] and a[p - 1] in shared))
        longest = max(common(s, t) for m, (_, t) in enumerate(suffix) if m != n)
        assert longest == max(r.lcp, got[n + 1].lcp if n + 1 < len(got) else 0)


def test_blocks_of_the_suffix_array_join(spark, monkeypatch):
    monkeypatch.setattr(L, "_BLOCK", 4)
    docs = [(i, "\n".join(["a", "b", "c", "d", "e"] * 3 + [str(i % 4)] * 2)) for i in range(12)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.kept_text, r.n_lines, r.n_removed, r.n_runs) for r in L.line_dedup(table, 2).collect()}
    assert got == brute(docs, 2, 50)


def test_texts_beyond_a_piece(spark):
    """Runs of lines in texts of more than a megabyte: later copies go, also within one text."""
    rnd = random.Random(2)
    line = lambda k: f"line {k} " + " ".join(f"w{rnd.randrange(9999)}" for _ in range(18))
    own = [[line(f"{d}.{k}") for k in range(12_000)] for d in range(2)]
    shared = [line(f"s.{k}") for k in range(40)]
    texts = ["\n".join(own[0][:6000] + shared + own[0][6000:] + shared), "\n".join(shared + own[1])]
    assert all(len(t) > 1 << 20 for t in texts)
    got = {r.doc_id: (r.kept_text, r.n_removed, r.n_runs) for r in L.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: ("\n".join(own[0][:6000] + shared + own[0][6000:]), 40, 1), 1: ("\n".join(own[1]), 40, 1)}
