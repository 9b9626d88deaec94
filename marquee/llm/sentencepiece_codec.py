"""SentencePiece encoding and decoding with the tokenizers library.

The model's protobuf is parsed here and rebuilt from the library's parts: normaliser,
metaspace marker, merges or unigram scores, and byte fallback. SentencePiece itself reads
each distinct chunk too, among others, and a text whose ids differ is flagged.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokenizer_files
from .chunks import ChunkCoder, Flat, worker_cache
from .text import flat_index, pieces, trim, utf8

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Threads of a task that encode a batch, chunks encoded at once (each has some 600 bytes meanwhile), and characters of
#: the rows of chunks that SentencePiece reads.
THREADS, _AT_ONCE, _ROW_CHARS = 2, 8192, 4096


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_mark: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: integers, or bytes for all else."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        wire = key & 7
        if wire == 0:
            value, at = varint(at)
        else:
            size, at = (8, at) if wire == 1 else (4, at) if wire == 5 else varint(at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


def parse_model(raw: bytes) -> Model:
    """The parts of a SentencePiece model that encoding and decoding need."""
    model = Model()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            found = dict(_fields(value))
            model.kind = found.get(3, UNIGRAM)
            model.byte_fallback, model.suffix_mark = bool(found.get(35, 0)), bool(found.get(24, 0))
        elif number == 3:
            found = dict(_fields(value))
            model.charsmap = found.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = (bool(found.get(n, 1)) for n in (3, 4, 5))
    return model


def chunkable(model: Model) -> bool:
    """Whether ids can be made chunk by chunk: no normalisation, and no piece has a mark after other characters."""
    plain = not (model.charsmap or model.squeeze or model.suffix_mark) and model.escape and model.dummy_prefix
    return plain and not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED))


def build(model: Model, prefix: bool = True):
    """A tokenizers.Tokenizer equal to the model; without `prefix`, texts bring their own dummy prefix."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.suffix_mark:
        raise ValueError("models with white space as a suffix are not supported")
    ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    unknown = next((p for p, _, kind in model.pieces if kind == UNKNOWN), None)
    if model.kind == BPE:
        usable = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
        splits = [(-s, ids[p], ids[p[:k]], ids[p[k:]]) for p, s in usable.items() for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
        names = [p for p, _, _ in model.pieces]
        merges = [(names[a], names[b]) for _, _, a, b in sorted(splits)]
        core = models.BPE(vocab=ids, merges=merges, unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=ids.get(unknown), byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only BPE and unigram models are supported")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix and prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        out.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED)):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+"), "merged_with_next")
    own = [AddedToken(p, normalized=False, special=False) for p, _, kind in model.pieces if kind == USER_DEFINED]
    if own:
        out.add_tokens(own)
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []))
    return out


#: Bytes of texts that a worker encodes and decodes at once.
_PIECE = 1 << 18
#: Chunks that a worker keeps: a table of some 40 bytes each and their ids.
CACHED_CHUNKS = 1_000_000


class Codec:
    """A worker's encoder and decoder for one model."""

    def __init__(self, raw: bytes, threads: int):
        import sentencepiece

        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        self.model, self.threads = parse_model(raw), threads
        self.judge = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.by_chunk = chunkable(self.model)
        self.tokenizer = build(self.model, prefix=not self.by_chunk)
        self.dtype = np.uint16 if len(self.model.pieces) < 1 << 16 else np.uint32
        self.coder = ChunkCoder(self._encode_chunks, self.dtype, CACHED_CHUNKS) if self.by_chunk else None
        shown = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else (" ⁇ " if kind == UNKNOWN else p.replace(MARK, " ")).encode() for p, _, kind in self.model.pieces]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.sizes = np.array([len(x) for x in shown], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes

    def _theirs(self, texts: list[str], first: np.ndarray) -> list[list[int]]:
        """SentencePiece's ids of each chunk alone."""
        return self.judge.encode([t if f else t[1:] for t, f in zip(texts, first)], num_threads=self.threads)

    def _encode(self, texts: list[str], first: np.ndarray) -> tuple[list, np.ndarray]:
        """Ids of chunks, and whether SentencePiece gives others. A first chunk gets the dummy prefix; others begin with their space.

        SentencePiece reads chunks in a row, as texts of some length, so that its ids also differ
        where the chunks' ids would depend on their neighbours; only then it reads each alone.
        """
        if not self.by_chunk:
            ours = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            theirs = self.judge.encode(texts, num_threads=self.threads)
            return ours, np.fromiter((a != b for a, b in zip(ours, theirs)), np.uint8, len(ours))
        ours = [e.ids for e in self.tokenizer.encode_batch_fast([" " + t if f else t for t, f in zip(texts, first)], add_special_tokens=False)]
        rows: list[list[int]] = []
        size, closed = 0, True
        for i, (t, f) in enumerate(zip(texts, first.tolist())):
            if f or closed or size > _ROW_CHARS:
                rows.append([])
                size = 0
            rows[-1].append(i)
            size += len(t)
            closed = t[-1].isspace() or t[-1] in "\x7f\u180e"
        differs = np.zeros(len(texts), np.uint8)
        for row, theirs in zip(rows, self._theirs(["".join([texts[i] for i in row]) for row in rows], first[[row[0] for row in rows]] if rows else first)):
            if [x for i in row for x in ours[i]] != theirs:
                alone = self._theirs([texts[i] for i in row], first[row])
                apart = [ours[i] != x for i, x in zip(row, alone)]
                differs[row] = apart if any(apart) else 1
        return ours, differs

    def _encode_chunks(self, texts: list[str], first: np.ndarray) -> tuple[Flat, np.ndarray]:
        """The same of many chunks, some at a time."""
        values, lengths, flags = [], [], []
        for a in range(0, len(texts), _AT_ONCE):
            ours, differs = self._encode(texts[a : a + _AT_ONCE], first[a : a + _AT_ONCE])
            lengths.append(np.fromiter(map(len, ours), np.int64, len(ours)))
            values.append(np.fromiter((i for x in ours for i in x), self.dtype, int(lengths[-1].sum())))
            flags.append(differs)
        return Flat(np.concatenate(values), np.concatenate(lengths)), np.concatenate(flags)

    def encode(self, texts, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in a row, n + 1 offsets by text, and which texts have parity with SentencePiece."""
        if self.coder is not None:
            ids, at, differs = self.coder.values(data, offsets)
            return ids, at, ~differs
        lists, differs = self._encode(texts(), np.ones(0, bool))
        at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        return np.fromiter((i for x in lists for i in x), self.dtype, int(at[-1])), at, differs == 0

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts in a row and n + 1 offsets; a dummy prefix is taken off."""
        ids = ids.astype(np.int64)
        data = self.shown[flat_index(self.places[ids], self.sizes[ids])]
        offsets = np.concatenate([[0], np.cumsum(self.sizes[ids])])[at]
        if self.model.dummy_prefix:
            full = offsets[1:] > offsets[:-1]
            begins = offsets[:-1][full]
            begins = begins[data[begins] == 32]
            data = np.delete(data, begins)
            offsets = offsets - np.searchsorted(begins, offsets, "left")
        return data, offsets


def codec(raw: bytes, version: str, threads: int = THREADS) -> Codec:
    return worker_cache(version, "codec", lambda: Codec(raw, threads))


def encode(docs: DataFrame, model_path: str, threads: int = THREADS) -> DataFrame:
    """Rows (doc_id, text, ids array<int>, parity) for each row of `docs`, in any order.

    `parity` says that SentencePiece gives the same ids. A null text is empty and has no ids;
    other columns are ignored; repeated rows and null doc_ids stay. Nothing is shuffled.
    """
    raw, _, version = tokenizer_files.load(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(raw, version, threads)
        for batch in pieces(batches, limit=_PIECE):
            column = batch.column("text")
            ids, at, parity = own.encode(lambda c=column: [x or "" for x in c.to_pylist()], *utf8(column))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column, lists, pa.array(parity)], ["doc_id", "text", "ids", "parity"])

    return docs.select("doc_id", "text").mapInArrow(run, _schema(docs, "text string, ids array<int>, parity boolean"))


def _schema(docs: DataFrame, rest: str) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {rest}"


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """Rows (doc_id, decoded) from (doc_id, ids): bytes of a broken sequence become U+FFFD; null or no ids give an empty text."""
    raw, _, version = tokenizer_files.load(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(raw, version)
        for batch in batches:
            column = batch.column("ids")
            sizes = np.asarray([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
            data, offsets = own.decode(column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]))
            raw_bytes = data.tobytes()
            texts = [raw_bytes[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, _schema(encoded, "decoded string"))


def round_trip(docs: DataFrame, model_path: str, threads: int = THREADS) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, ids_crc32, round_trip, parity), encoded and decoded in one pass.

    ids_crc32 is the unsigned crc32 of the ids as little-endian unsigned 32-bit integers;
    round_trip says that the decoded text is the text. The rules of encode() and decode() hold.
    """
    raw, _, version = tokenizer_files.load(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(raw, version, threads)
        for batch in pieces(batches, limit=_PIECE):
            column = batch.column("text")
            data, offsets = utf8(column)
            ids, at, parity = own.encode(lambda c=column: [x or "" for x in c.to_pylist()], data, offsets)
            back, places = own.decode(ids, at)
            little, was, now = ids.astype("<u4").tobytes(), data.tobytes(), back.tobytes()
            spans = list(zip(at[:-1].tolist(), at[1:].tolist()))
            same = [was[a:b] == now[c:d] for a, b, c, d in zip(offsets[:-1].tolist(), offsets[1:].tolist(), places[:-1].tolist(), places[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.diff(at)), pa.array([zlib.crc32(little[4 * a : 4 * b]) for a, b in spans], pa.int64()), pa.array(same), pa.array(parity)],
                ["doc_id", "n_bytes", "n_tokens", "ids_crc32", "round_trip", "parity"],
            )
            trim()

    return docs.select("doc_id", "text").mapInArrow(run, _schema(docs, "n_bytes long, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean"))
