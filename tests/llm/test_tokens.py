import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from marquee.llm import exact_dedup, sentencepiece_codec, token_counts, token_shards, tokenizer_files
from marquee.llm.store import fresh_path
from marquee.llm.text import utf8
from marquee.llm.wavelet import WaveletMatrix

TEXTS = [
    "", None, " ", "  ", "a", " a", "a ", "the cat  sat\n\n on the\tmat ", "don't  stop now 　 wide", "x  y  z é à",
    "<|endoftext|> a <|endoftext|>b", "日本語 テキスト ありがとう", "🙂 🙃", "▁a ▁ b▁c", "\r\n \r\n", "a\u0085 b", "x " * 3000, "y" * 5000, "é" * 700 + " z",
    "word 123 4,567.89 -- ok", "the cat  sat\n\n on the\tmat ", "\x00 \x01 a", "tab\t tab", "A" * 3 + " " * 40 + "b",
]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "extra", i) for i, t in enumerate(TEXTS)] + [(None, "no id", "extra", 1), (3, " a", "extra", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, n_tokens int")


def want_ids(text):
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return t.encode(text or "", add_special_tokens=False).ids


def test_counts_and_cache(spark, docs):
    cache = fresh_path(spark, "cache")
    for _ in range(2):  # the second call finds all counts in the cache
        got = token_counts.token_counts(docs, P.path("byte_bpe_50k.json"), cache).collect()
        assert len(got) == len(TEXTS) + 2
        by = {r.doc_id: r for r in got if r.doc_id not in (None, 3)}
        for i, t in enumerate(TEXTS):
            if i != 3:
                assert (by[i].n_tokens, by[i].n_bytes) == (len(want_ids(t)), len((t or "").encode())), t
                assert by[i].over_limit == (by[i].n_tokens > 512)
    assert spark.read.parquet(cache).count() == len({t or "" for t in TEXTS} | {"no id"})


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_counts_of_other_files(spark, docs, name):
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs.where("doc_id != 3"), P.path(name), fresh_path(spark, "c")).collect()}
    if name.endswith(".json"):
        t = tokenizers.Tokenizer.from_file(P.path(name))
        want = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    else:
        s = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        want = lambda x: len(s.encode(x))
    assert got == {i: want(t or "") for i, t in enumerate(TEXTS) if i != 3}


def test_shards_round_trip(spark, docs):
    path = fresh_path(spark, "shards")
    token_shards.write_token_shards(docs, P.path("byte_bpe_50k.json"), path, end_id=2, shard_bytes=4000)
    got = token_shards.read_token_shards(spark, path, with_ids=True).orderBy("start").collect()
    assert len(got) == len(TEXTS) + 2 and got[0].doc_id is None
    at, last = 0, -1
    for r in got:
        text = "no id" if r.doc_id is None else " a" if r.doc_id == 3 and r.ids[:-1] == want_ids(" a") else TEXTS[r.doc_id]
        want = want_ids(text) + [2]
        assert r.ids == want and r.start == at and r.n_tokens == len(want)
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        assert r.doc_id is None or r.doc_id >= last
        at, last = at + r.n_tokens, -1 if r.doc_id is None else r.doc_id
    found = token_shards.find_token(spark, path, 2).agg({"count": "sum"}).first()[0]
    all_ids = [i for r in got for i in r.ids]
    counts = {r.start: r.n_of_token for r in token_shards.read_token_shards(spark, path, token=2).collect()}
    assert counts == {r.start: r.ids.count(2) for r in got}
    shards = sorted((r.part, r.seq, r.n_tokens) for r in spark.read.parquet(path).select("part", "seq", "n_tokens").collect())
    before, at = {}, 0
    for part, seq, n in shards:
        before[part, seq], at = at, at + n
    where = [before[r.part, r.seq] + p for r in token_shards.find_token(spark, path, 1169).collect() for p in r.positions]
    assert len(where) > 0 and sorted(where) == [i for i, x in enumerate(all_ids) if x == 1169]
    asked = spark.createDataFrame([(part, seq, w) for part, seq, n in shards for w in range(0, n + 3, 7)], "part int, seq int, within int")
    read = {before[r.part, r.seq] + r.within: r.token for r in token_shards.token_at(spark, path, asked).collect()}
    assert len(read) == sum(-(-n // 7) for _, _, n in shards) and all(all_ids[i] == x for i, x in read.items())
    assert found == sum((want_ids("no id") + want_ids(" a") + sum(map(want_ids, TEXTS), [])).count(x) for x in (2,)) + len(TEXTS) + 2


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 511, 512, 513, 70_000, 140_001):  # about a block, and beyond one step
        values = rng.integers(0, 300, n).astype(np.uint32)
        w = WaveletMatrix.build(values, 9)
        assert (w.decode() == values).all() and (w.access(np.arange(n)) == values).all()
        i = np.unique(rng.integers(0, n + 1, 50))
        few = WaveletMatrix(w.n, w.width, w.zeros, w.raw, w.ranks)
        for k in i[:20].tolist():  # one at a time, from the stored directories
            few._planes = [None] * few.width
            assert few.rank(values[0], np.array([k])).tolist() == [int((values[:k] == values[0]).sum())]
        assert w.rank(values[0], i).tolist() == [int((values[:k] == values[0]).sum()) for k in i]
        assert (w.occurrences(int(values[0])) == np.flatnonzero(values == values[0])).all()
    values = rng.integers(0, 50, 3000).astype(np.uint16)
    w = WaveletMatrix.build(values, 6)
    assert (w.decode() == values).all() and (w.access(np.arange(3000)) == values).all()
    for s in (0, 7, 49, 63):
        assert (w.occurrences(s) == np.flatnonzero(values == s)).all()
        i = np.array([0, 1, 511, 512, 2999, 3000])
        assert w.rank(s, i).tolist() == [int((values[:k] == s).sum()) for k in i]
    empty = WaveletMatrix.build(np.zeros(0, np.uint16), 1)
    assert len(empty.decode()) == 0 and empty.count(0) == 0


def test_sentencepiece(spark, docs):
    s = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    plain = docs.where("doc_id is not null").where("doc_id != 3")
    encoded = sentencepiece_codec.encode(plain, P.path("piece_bpe_32k.model"))
    for r in encoded.collect():
        assert r.ids == s.encode(TEXTS[r.doc_id] or ""), TEXTS[r.doc_id]
        assert r.parity
    for r in sentencepiece_codec.decode(encoded, P.path("piece_bpe_32k.model")).collect():
        assert r.decoded == s.decode(s.encode(TEXTS[r.doc_id] or ""))
    for r in sentencepiece_codec.round_trip(docs, P.path("piece_bpe_32k.model")).collect():
        if r.doc_id not in (None, 3):
            ids = s.encode(TEXTS[r.doc_id] or "")
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            assert r.round_trip == (s.decode(ids) == (TEXTS[r.doc_id] or ""))


def test_unigram_model_is_rebuilt():
    model = sentencepiece_codec.Model(kind=sentencepiece_codec.UNIGRAM, squeeze=False, byte_fallback=True)
    model.pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -2.2, 1), ("▁ab", -3.1, 1)] + [(f"<0x{i:02X}>", -9.0, 6) for i in range(256)]
    t = sentencepiece_codec.build(model)
    assert t.encode("ab ba", add_special_tokens=False).tokens == ["▁ab", "▁", "b", "a"]
    assert t.decode(t.encode("ab é", add_special_tokens=False).ids) == "ab é"


def _field(number, value):
    varint = lambda n: bytes([*(n >> 7 * k & 127 | 128 for k in range(max(n.bit_length() - 1, 0) // 7)), n >> 7 * (max(n.bit_length() - 1, 0) // 7)])
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram_proto(squeeze=False):
    """A unigram model with byte fallback, written out as SentencePiece stores it."""
    words = ["▁", "a", "b", "t", "h", "e", "▁th", "▁the", "the", "he", "ab", "▁ab", "ba", "▁a", "é", "at", "eat", "▁eat", "hea", "t▁", "。", "日本"]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", -20.0 - i / 256, 6) for i in range(256)] + [(w, -2.0 - 0.37 * i, 1) for i, w in enumerate(words) if w != "t▁"]
    out = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, k)) for p, s, k in pieces)
    return out + _field(2, _field(3, 1) + _field(35, 1)) + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, int(squeeze)) + _field(5, 1))


def test_unigram_scores_give_the_ids_of_sentencepiece(spark, tmp_path):
    (tmp_path / "unigram.model").write_bytes(unigram_proto())
    judge = sentencepiece.SentencePieceProcessor(model_file=f"{tmp_path}/unigram.model")
    rnd = random.Random(8)
    texts = ["the heat ab", " the", "a  b", "日本。 the é ü", "", None, "abab" * 400] + ["".join(rnd.choice(["a", "b", "t", "h", "e", " ", "é", "日本", "the", "x"]) for _ in range(rnd.randrange(1, 80))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sentencepiece_codec.encode(docs, f"{tmp_path}/unigram.model").collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.ids == judge.encode(r.text or "") and r.parity, r.text
    for r in sentencepiece_codec.round_trip(docs, f"{tmp_path}/unigram.model").collect():
        ids = judge.encode(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.round_trip == (judge.decode(ids) == (texts[r.doc_id] or ""))


def test_parity_sees_what_depends_on_neighbours():
    raw = tokenizer_files.load(P.path("piece_bpe_32k.model"))[0]
    own = sentencepiece_codec.Codec(raw, 2)
    data, offsets = utf8(pa.array(["the cat sat on a mat", "one two three"]))
    assert own.encode(None, data, offsets)[2].all()
    own = sentencepiece_codec.Codec(raw, 2)
    whole, own.judge = own.judge, type("Judge", (), {"encode": lambda self, texts, num_threads: [ids if " " not in t else [*ids, 5] for t, ids in zip(texts, whole.encode(texts))]})()
    assert not own.encode(None, data, offsets)[2].any()  # chunks alone agree, rows of chunks don't


def test_long_texts_and_hot_ids(spark):
    """Texts beyond the pieces that tasks work on, and many rows of one id."""
    long = "the cat 12 sat, on é\n" * 80_000
    rows = [(1, long), (2, long + "x"), (3, "y" * 1_200_000), (4, long)] + [(7, f"t {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = fresh_path(spark, "long")
    token_shards.write_token_shards(docs, P.path("byte_bpe_50k.json"), path, end_id=2, shard_bytes=400_000)
    got = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in token_shards.read_token_shards(spark, path).collect()}
    assert got == {(i, len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for i, t in rows for w in [want_ids(t) + [2]]}
    counts = {(r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, P.path("byte_bpe_50k.json"), fresh_path(spark, "c")).collect()}
    assert counts == {(i, len(t.encode()), len(want_ids(t))) for i, t in rows}
    judge = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    found = {(r.doc_id, r.n_tokens, r.round_trip, r.parity) for r in sentencepiece_codec.round_trip(docs, P.path("piece_bpe_32k.model")).collect()}
    assert found == {(i, len(judge.encode(t)), True, True) for i, t in rows}
    kept = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()}
    assert kept >= {(1, 4, 2), (4, 4, 2), (2, 2, 1), (3, 3, 1)}


def test_exact_dedup(spark):
    rows = [(1, "Ab", 0), (2, "aB", 0), (3, None, 0), (4, "", 0), (5, "É", 0), (6, "é", 0), (2, "ab", 0), (None, "Q", 0), (None, "q", 0), (None, "ab", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(low(t), []).append(i)
    want = []
    for i, t, _ in rows:
        ids = [x for x in groups[low(t)] if x is not None]
        keep = max(ids) if ids else None
        want.append((i, keep, len(groups[low(t)]), i == keep, sha(low(t))))
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_lone_rows_pass_at_any_number_of_ranges(spark, monkeypatch):
    docs = spark.range(0, 60_000, numPartitions=3).selectExpr("id AS doc_id", "cast(if(id < 20000, 0, id % 50000) AS string) AS text")
    keys = exact_dedup.digests(docs)
    repeated = keys.groupBy("digest").count().where("count > 1")
    for most in (1 << 30, 1 << 16):
        monkeypatch.setattr(exact_dedup, "MOST_SLOTS", most)
        got = exact_dedup.exact_dedup(docs)
        assert got.count() == 60_000 and got.where("kept").count() == 40_000
        maybe = exact_dedup.flagged(keys)
        assert maybe.where("NOT maybe").join(repeated, "digest", "left_semi").count() == 0
        assert maybe.where("maybe").join(repeated, "digest", "left_anti").count() < 0.02 * 40_000


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_dedup(none).count() == 0
    assert token_counts.token_counts(none, P.path("byte_bpe_50k.json"), fresh_path(spark, "c")).count() == 0
    path = fresh_path(spark, "s")
    token_shards.write_token_shards(none, P.path("byte_bpe_50k.json"), path, 2)
    assert token_shards.read_token_shards(spark, path).count() == 0
    assert sentencepiece_codec.round_trip(none, P.path("piece_bpe_32k.model")).count() == 0


def test_written_tables_can_be_cleared(spark):
    from marquee.llm import store

    with store.Scope() as own:
        table = store.written(spark.range(3).toDF("x"), "t")
    assert table.count() == 3
    path = own.tables[0]
    own.clear(spark)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_many_empty_texts_fill_several_shards(spark):
    docs = spark.range(0, 6000, numPartitions=3).selectExpr("id AS doc_id", "if(id % 2 = 0, '', null) AS text")
    path = fresh_path(spark, "empty")
    token_shards.write_token_shards(docs, P.path("byte_bpe_50k.json"), path, end_id=2, shard_bytes=8000)
    per = [r.n_docs for r in spark.read.schema(token_shards.SHARD_SCHEMA).parquet(path).collect()]
    assert sum(per) == 6000 and len(per) >= 5 and max(per) <= 2500
    rows = token_shards.read_token_shards(spark, path).collect()
    assert {(r.doc_id, r.start, r.n_tokens) for r in rows} == {(i, i, 1) for i in range(6000)}


def test_only_texts_without_a_count_shuffle(spark, monkeypatch):
    """One new text, and nothing that Spark may broadcast by itself: the other texts stay where they are."""
    cache, name = fresh_path(spark, "c"), P.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    token_counts.token_counts(docs, name, cache).count()
    plans, written = [], token_counts.written

    def seen(df, tag, **more):
        if tag == "counted":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            assert df.count() == 1  # encoded
        return written(df, tag, **more)

    monkeypatch.setattr(token_counts, "written", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        more = docs.unionByName(spark.createDataFrame([(999, "a new text")], docs.schema))
        got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(more, name, cache).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {**{i: len(want_ids(f"text {i}")) for i in range(200)}, 999: len(want_ids("a new text"))}
    assert len(plans) == 1 and "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]
    below = plans[0][plans[0].index("BroadcastHashJoin"):]
    assert "hashpartitioning" not in below  # no exchange of texts before the join


def test_chunks_are_encoded_some_at_a_time(monkeypatch):
    """All new chunks of a batch were encoded at once, with some 600 bytes of encodings each."""
    raw, _, _ = tokenizer_files.load(P.path("piece_bpe_32k.model"))
    column = pa.array([" ".join(f"word{i} Straße" for i in range(k, k + 40)) for k in range(0, 90, 30)] + ["", None])
    want = sentencepiece_codec.Codec(raw, 1).encode(None, *utf8(column))
    own, seen = sentencepiece_codec.Codec(raw, 1), []
    monkeypatch.setattr(sentencepiece_codec, "_AT_ONCE", 7)
    encode = own._encode
    monkeypatch.setattr(own, "_encode", lambda texts, first: seen.append(len(texts)) or encode(texts, first))
    got = own.encode(None, *utf8(column))
    assert max(seen) <= 7 and all((a == b).all() for a, b in zip(got, want)) and got[2].all()
    assert got[0][: got[1][1]].tolist() == own.judge.encode(column[0].as_py())
