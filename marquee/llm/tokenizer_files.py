"""Tokenizer files: read once on the driver and sent to the tasks as bytes."""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np

from .chunks import ChunkCoder, Flat, worker_cache
from .text import flat_index


def load(path: str) -> tuple[bytes, str, str]:
    """A file's bytes, its kind (json or model) and its version digest."""
    with open(path, "rb") as f:
        raw = f.read()
    kind = "model" if path.endswith(".model") else "json"
    return raw, kind, hashlib.sha256(raw).hexdigest()


def chunkable(raw: bytes) -> bool:
    """Whether a text's ids are its chunks' ids: byte-level BPE with its own pattern, unnormalised."""
    spec = json.loads(raw)
    pre = spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) and " " not in t["content"] for t in added)
    return bool(pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and plain)


def whole_text_encoder(raw: bytes, kind: str):
    """A function from texts to id lists, as the file's own library gives them."""
    if kind == "model":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        return lambda texts, _=None: model.encode(texts, num_threads=1)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(raw.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts, _=None: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_JOINED_BYTES = 16 << 10


def joined_encoder(raw: bytes, dtype):
    """Encodes many chunks at a time by joining them to longer texts.

    A chunk that begins with a space and ends in a character that isn't white space has the same
    ids between others as alone. How many bytes each id stands for tells the chunks' ids apart.
    """
    spec = json.loads(raw)
    own, whole = spec["model"]["vocab"], whole_text_encoder(raw, "json")
    sizes = np.zeros(max([*own.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1, np.int64)
    for token, i in own.items():
        sizes[i] = len(token)  # one character a byte
    for t in spec.get("added_tokens", []):
        sizes[t["id"]] = len(t["content"].encode())

    def encode(texts: list[str], first: np.ndarray) -> Flat:
        lengths = np.zeros(len(texts), np.int64)
        apart = [bool(f) or t[0] != " " or t[-1].isspace() or t[-1] in "\x7f\u180e" for t, f in zip(texts, first.tolist())]
        inner = np.flatnonzero(~np.array(apart, bool))
        ends = np.cumsum(np.fromiter((len(texts[i].encode()) for i in inner.tolist()), np.int64, len(inner)))
        cuts = np.flatnonzero(np.diff(ends // _JOINED_BYTES, prepend=0)) if len(ends) else ends
        bounds = [0, *[c for c in cuts.tolist() if c], len(inner)]
        groups = ["".join([texts[i] for i in inner[a:b].tolist()]) for a, b in zip(bounds, bounds[1:]) if b > a]
        ids = np.concatenate([np.zeros(0, dtype), *[np.array(x, dtype) for x in whole(groups)]])
        places = np.cumsum(sizes[ids])
        at = np.searchsorted(places, ends) + 1
        if len(ends) and (at[-1] != len(ids) or not np.array_equal(places[at - 1], ends)):
            raise ValueError("ids don't fall apart at chunks")
        lengths[inner] = np.diff(at, prepend=0)
        outer = np.flatnonzero(apart)
        lists = whole([texts[i] for i in outer.tolist()])
        lengths[outer] = [len(x) for x in lists]
        starts = np.cumsum(lengths) - lengths
        flat = np.zeros(int(lengths.sum()), dtype)
        flat[flat_index(starts[inner], lengths[inner])] = ids
        flat[flat_index(starts[outer], lengths[outer])] = np.fromiter((i for x in lists for i in x), dtype, int(lengths[outer].sum()))
        return Flat(flat, lengths)

    return encode


def coder(raw: bytes, kind: str, version: str, threads: int = 1) -> ChunkCoder | None:
    """This worker's chunk coder for a file; None where whole texts must be encoded."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")

    def make() -> ChunkCoder | None:
        if kind != "json" or not chunkable(raw):
            return None
        spec = json.loads(raw)
        largest = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])
        dtype = np.uint16 if largest < 1 << 16 else np.uint32
        return ChunkCoder(joined_encoder(raw, dtype), dtype)

    return worker_cache(version, "chunks", make)


def ids_of(raw: bytes, kind: str, version: str, texts, data: np.ndarray, offsets: np.ndarray, threads: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row and n + 1 offsets by text; `texts` gives the texts if they are needed whole."""
    if (own := coder(raw, kind, version, threads)) is not None:
        ids, at, _ = own.values(data, offsets)
        return ids, at
    lists = worker_cache(version, "texts", lambda: whole_text_encoder(raw, kind))(texts())
    at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return np.fromiter((i for x in lists for i in x), np.uint32, int(at[-1])), at
