import random

import numpy as np
import pyarrow as pa

from marquee.llm import license_scan as L


def full_alignment(text, template):
    """Most words matched by a best local alignment, without a band."""
    n, m = len(text), len(template)
    score = np.zeros((m + 1, n + 1), int)
    best = 0
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            score[i, j] = max(0, score[i - 1, j - 1] + (L.MATCH if text[j - 1] == template[i - 1] else L.MISS), score[i - 1, j] + L.GAP, score[i, j - 1] + L.GAP)
            best = max(best, score[i, j])
    return best


def test_banded_alignment_finds_the_best_score():
    rnd = random.Random(2)
    for _ in range(20):
        template = np.array([rnd.randrange(1000) for _ in range(20)])
        copy = [w if rnd.random() > 0.1 else 5000 for w in template.tolist()]
        copy.insert(7, 6000)
        text = np.array([rnd.randrange(2000, 3000) for _ in range(30)] + copy + [rnd.randrange(2000, 3000) for _ in range(30)])
        hits, a, b, score = L.align(text, template, 30)
        assert score == full_alignment(text.tolist(), template.tolist())
        assert 30 <= a < b <= 30 + len(copy)


def test_scan(spark):
    filler = "lorem ipsum dolor sit amet consectetur " * 20
    notice = L.TEMPLATES["MIT-notice"]
    edited = notice.replace("free of charge", "at no charge").replace("merge, ", "")
    texts = [
        filler, filler + "Released under the MIT License. " + filler, None, "", "released UNDER the mit\nlicense", filler + edited + filler,
        "Licensed under CC BY-NC 4.0." + filler + "Licensed under CC BY-NC 4.0.", "Released under the BSD terms", notice[:150], "under the", L.TEMPLATES["GPL-3.0"] * 2,
    ]
    docs = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)] + [(None, texts[1], "m"), (4, texts[4], "m")], "doc_id long, text string, matches string")
    got = L.scan_licenses(docs).collect()
    assert len(got) == len(texts) + 2
    by = {r.doc_id: [(m["license"], round(m["coverage"], 2), texts[r.doc_id or 1].encode()[m["from"] : m["to"]].decode()) for m in r.matches] for r in got}
    assert by[0] == by[2] == by[3] == by[9] == []
    assert by[1] == by[None] == [("MIT", 1.0, "Released under the MIT License")]
    assert by[4] == [("MIT", 1.0, "released UNDER the mit\nlicense")]
    assert [x[0] for x in by[5]] == ["MIT-notice"] and by[5][0][1] > 0.9 and by[5][0][2].startswith("Permission")
    assert [x[0] for x in by[6]] == ["CC-BY-NC-4.0"] * 2
    assert by[8] == []
    assert [x[0] for x in by[10]] == ["GPL-3.0", "GPL-3.0"]


def test_every_planted_copy_is_found(spark):
    rnd = random.Random(5)
    words = ["w%d" % i for i in range(300)]
    templates = {"t%d" % k: " ".join(rnd.choice(words) for _ in range(rnd.choice([2, 3, 6, 40]))) for k in range(12)}
    docs, want = [], []
    for i in range(40):
        name = rnd.choice(sorted(templates))
        docs.append((i, " ".join(["x%d" % rnd.randrange(99) for _ in range(rnd.randrange(0, 50))] + [templates[name]] + ["y"] * rnd.randrange(0, 9))))
        want.append(name)
    got = {r.doc_id: {m["license"] for m in r.matches if m["coverage"] == 1} for r in L.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), templates).collect()}
    assert all(want[i] in got[i] for i in range(40))


def whole_alignment(text, template):
    """Matches of the best local alignment of all words of both."""
    return L.align(text, template, 0, len(text) + len(template))[0] if len(text) else 0


def test_edited_copies_are_found_as_by_whole_alignment(spark):
    rnd = random.Random(11)
    docs = ["Released under an MIT License.", "Released under the so called MIT style License", "x released y under z the u mit v license w", "see: licensed under cc by sa 4 0"]
    for name, template in sorted(L.TEMPLATES.items()) * 9:
        words = template.split()
        for _ in range(rnd.randrange(1, max(2, len(words) // 3))):
            k = rnd.randrange(len(words))
            words[k : k + rnd.choice([0, 1, 1])] = rnd.choice([["other"], ["new", "words"], [], ["w%d" % i for i in range(rnd.randrange(1, 14))]])
            words = words or ["the"]
        filler = [rnd.choice(["the", "of", "lorem", "ipsum", "software", "license"]) for _ in range(rnd.randrange(0, 20))]
        docs.append(" ".join([*filler, "q", *words]))
    got = L.scan_licenses(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    found, edges = {(r.doc_id, m["license"]): m["coverage"] for r in got for m in r.matches}, 0
    hashes, _, _, before = L.words_of(*L.utf8(pa.array(docs, pa.large_string())))
    templates = L.Templates(sorted(L.TEMPLATES.items()))
    for d in range(len(docs)):
        for name, words in zip(templates.names, templates.words):
            coverage = whole_alignment(hashes[before[d] : before[d + 1]], words) / len(words)
            if coverage >= L.COVERAGE:
                assert found[d, name] >= coverage, (docs[d], name)
                edges += coverage < 1
    assert edges > 30 and found[0, "MIT"] == 0.8 and found[1, "MIT"] == found[2, "MIT"] == 1 and found[3, "CC-BY-NC-4.0"] > 0.85


def test_adjacent_copies_stay_apart(spark):
    texts = ["Released under the MIT License. " * 40, "Released under an MIT License. " * 40]
    got = L.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: [m["coverage"] for m in r.matches] for r in got} == {0: [1.0] * 40, 1: [0.8] * 40}


def test_ties_long_texts_and_blocks(spark):
    """Whole texts beyond a piece, equal templates, repeated rows; blocks of templates find the same."""
    mit, isc = L.TEMPLATES["MIT-text"], L.TEMPLATES["ISC-text"]
    long = "lorem ipsum " * 60_000 + mit + " dolor sit " * 60_000 + isc
    docs = spark.createDataFrame([(1, long), (2, mit), (2, mit), (None, isc), (3, None)], "doc_id long, text string")
    templates = {**L.TEMPLATES, "MIT-again": mit}
    one, many = (sorted(map(str, L.scan_licenses(docs, templates, block_words=n).collect())) for n in (1 << 20, 60))
    assert one == many
    got = [(r.doc_id, {m["license"]: (m["coverage"], m["from"]) for m in r.matches}) for r in L.scan_licenses(docs, templates).collect()]
    at = len("lorem ipsum " * 60_000)
    found = next(m for i, m in got if i == 1)
    assert found["MIT-text"] == found["MIT-again"] == (1.0, at) and found["MIT-notice"] == (1.0, at) and found["ISC-text"][0] == 1.0
    assert [m["MIT-text"] for i, m in got if i == 2] == [(1.0, 0)] * 2 and next(m for i, m in got if i is None)["ISC-text"] == (1.0, 0)
    assert next(m for i, m in got if i == 3) == {}


def test_rows_of_an_alignment_equal_cells():
    def cells(text, template, diagonal, band):
        low, high = max(0, diagonal - band), min(len(text), diagonal + len(template) + band)
        part, n = text[low:high], max(high - low, 0)
        rows, best = [(0, 0, j) for j in range(n + 1)], (0, 0, 0, 0)
        for i, word in enumerate(template):
            new = [(0, 0, j) for j in range(n + 1)]
            for j in range(max(1, diagonal + i - band - low + 1), min(n, diagonal + i + band - low + 1) + 1):
                same = part[j - 1] == word
                pair, skip, gap = rows[j - 1], rows[j], new[j - 1]
                new[j] = max(((pair[0] + (L.MATCH if same else L.MISS), pair[1] + same, pair[2]), (skip[0] + L.GAP, *skip[1:]), (gap[0] + L.GAP, *gap[1:]), (0, 0, j)), key=lambda o: o[0])
                if new[j][0] > best[3]:
                    best = (new[j][1], new[j][2] + low, j + low, new[j][0])
            rows = new
        return best

    rnd = random.Random(4)
    for _ in range(400):
        text, template = ([rnd.randrange(rnd.choice([2, 5, 20])) for _ in range(rnd.randrange(1, 25))] for _ in range(2))
        diagonal, band = rnd.randrange(-5, 20), rnd.choice([0, 2, 8, 40])
        assert L.align(np.array(text), np.array(template), diagonal, band) == cells(text, template, diagonal, band)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert L.scan_licenses(none).count() == 0
    assert L.scan_licenses(spark.createDataFrame([(1, "a")], "doc_id long, text string"), {}).first().matches == []
