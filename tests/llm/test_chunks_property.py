import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from marquee.llm import sentencepiece_codec, tokenizer_files
from marquee.llm.text import utf8

ODD = st.sampled_from([" ", "  ", "\n", "\t", " ", "\u0085", " ", "　", " ", "​", "\x1c", "\x7f", "a", "the", "'s", "é", "漢", "1", "<|endoftext|>", "<s>", "<0x41>", "▁", "🙂", "...", "-"])
TEXT = st.one_of(st.text(max_size=30), st.lists(ODD, max_size=14).map("".join))
RAW = tokenizer_files.load(P.path("byte_bpe_50k.json"))
WHOLE = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
MODEL = sentencepiece_codec.Codec(tokenizer_files.load(P.path("piece_bpe_32k.model"))[0], 1)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT.filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)), min_size=1, max_size=5))
def test_chunks_give_the_ids_of_whole_texts(texts):
    data, offsets = utf8(pa.array(texts, pa.string()))
    ids, at = tokenizer_files.ids_of(*RAW, None, data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]
    assert tokenizer_files.coder(*RAW).counts(data, offsets).tolist() == [len(WHOLE.encode(t, add_special_tokens=False).ids) for t in texts]


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT.filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)), min_size=1, max_size=5))
def test_sentencepiece_chunks_give_the_ids_of_whole_texts(texts):
    data, offsets = utf8(pa.array(texts, pa.string()))
    ids, at, parity = MODEL.encode(None, data, offsets)
    for t, a, b, same in zip(texts, at[:-1], at[1:], parity):
        assert (ids[a:b].tolist() == MODEL.judge.encode(t)) == bool(same)
        assert same or "\x00" in t, t
    back, places = MODEL.decode(ids, at)
    for t, a, b, c, d in zip(texts, places[:-1], places[1:], at[:-1], at[1:]):
        assert back[a:b].tobytes().decode("utf-8", "replace") == MODEL.judge.decode(ids[c:d].tolist())
