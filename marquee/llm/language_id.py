"""Language ID by a linear-chain CRF that labels each word.

Words carry affix, n-gram and lexicon features; learned transitions let the labels of
code-switched text change where the words do. A text's language is the label with the largest
mean marginal over all of its words.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import ChunkCoder, worker_cache
from .crf import CRF, train, word_features
from .text import pieces, spans_of, utf8

#: The sample that is learned from: texts a language, and the bytes of the longest that is drawn first.
SAMPLE_TEXTS, SAMPLE_BYTES = 300, 20_000
UNDETERMINED = "und"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
#: Distinct words whose scores a worker holds; scores are cheap to make again.
CACHED_WORDS = 200_000


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case; starts and ends of words; and the number of words before each offset."""
    starts, ends, before = spans_of(_LETTER[data], offsets)
    return _LOWER[data], starts, ends, before


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from learning: a fifth of all, by crc32 of the id; null ids too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, texts: int = SAMPLE_TEXTS, longest: int = SAMPLE_BYTES) -> CRF:
    """A model from a bounded sample of the labelled documents that are not held out.

    The sample has at most `texts` texts of each language and texts * longest bytes of them:
    those least by a hash of the row, of at most `longest` bytes each. Only where a language
    has too few of these do longer ones fill its sample, whole, as far as the bytes allow; of
    a first text that alone has more, the beginning is taken. Rows that hash beyond what a language's
    count calls for are left out, and only drawn texts move, so what moves doesn't grow with
    the table. Equal rows are one. Nothing but text and lang is learned from.
    """
    most = texts * longest
    size = F.octet_length("text")
    fit = docs.where(~held_out("doc_id")).where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("doc_id", "text").alias("draw"), size.alias("size"), (size > longest).alias("long"))
    counts = fit.groupBy("lang", "long").agg(F.count(F.lit(1)).alias("n"))  # two rows a label, as the model has
    share = F.shiftrightunsigned("draw", 11) / F.lit(float(1 << 53))
    near = fit.join(F.broadcast(counts), ["lang", "long"]).where(share * F.col("n") <= 2 * texts + 100).select("lang", "long", "draw", "size").distinct()
    order = Window.partitionBy("lang").orderBy("long", "draw")
    drawn = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= texts).withColumn("sum", F.sum("size").over(order)).where((F.col("sum") <= most) | (F.col("k") == 1)).select("lang", "draw", "long")
    whole = fit.join(F.broadcast(drawn), ["lang", "draw", "long"]).select("lang", "draw", F.when(F.col("size") <= most, F.col("text")).otherwise(F.substring("text", 1, most // 4)).alias("text"))
    one = whole.distinct().repartition(1).sortWithinPartitions("lang", "draw", "text").select("lang", "text")  # the bounded sample
    fitted = one.mapInArrow(_fitted, "model binary").first()
    return pickle.loads(fitted.model) if fitted else CRF.blank([])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of a whole sample, fitted in a task: its words and gradients take no memory of the driver."""

    def spans(data: np.ndarray):
        return spans_of(_LETTER[data], np.array([0, len(data)]))[:2]

    texts, langs = [], []
    for batch in batches:
        texts += [bytes(_LOWER[np.frombuffer(t.encode(), np.uint8)]) for t in batch.column("text").to_pylist()]
        langs += batch.column("lang").to_pylist()
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, langs, spans))], pa.binary())], ["model"])


def _scorer(model: CRF, version: str) -> ChunkCoder:
    """A worker's cache of word scores."""

    def score(texts: list[str], _) -> np.ndarray:
        raw = [t.encode() for t in texts]
        sizes = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes)
        return model.emissions(*word_features(data, ends - sizes, ends), sizes)

    return worker_cache(version, "scores", lambda: ChunkCoder(score, np.float32, CACHED_WORDS))


def marginals(model: CRF, version: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    labels = len(model.labels)
    own = _scorer(model, version)
    scores = np.empty((len(starts), labels), np.float32)
    for a in range(0, len(starts), CACHED_WORDS // 2):
        part = slice(a, a + CACHED_WORDS // 2)
        if own.n + len(starts[part]) > own.capacity:
            own._reset()
        entries = own.entries(data, starts[part], ends[part], np.zeros(len(starts[part]), bool))
        scores[part] = own.pool[own.starts[entries][:, None] + np.arange(labels)]
    return model.posteriors(scores, before)


def _share(spark, model: CRF):
    version = hashlib.sha256(model.weights.tobytes() + repr(model.labels).encode()).hexdigest()
    return spark.sparkContext.broadcast(model), version


def predict(docs: DataFrame, model: CRF) -> DataFrame:
    """Rows (doc_id, lang_pred, score), one for each row of `docs`.

    Only the text is read. A text that is null or without any letter, or a model without
    languages, gives `und` with score 0. Ties go to the first language by name. Other columns
    are ignored; repeated rows and null ids stay; nothing is shuffled.
    """
    shared, version = _share(docs.sparkSession, model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in pieces(batches):
            data, starts, ends, before = words_of(*utf8(batch.column("text")))
            names, score = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            if own.labels and len(starts):
                sums = np.concatenate([np.zeros((1, len(own.labels))), np.cumsum(marginals(own, version, data, starts, ends, before), axis=0)])
                n = np.diff(before)
                mean = (sums[before[1:]] - sums[before[:-1]]) / np.maximum(n, 1)[:, None]
                mean = np.clip(np.round(mean, 9), 0, 1)
                best = mean.argmax(axis=1)
                known = (n > 0) & batch.column("letters").to_numpy(zero_copy_only=False)
                names = [own.labels[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist())]
                score = np.where(known, mean[np.arange(len(best)), best], 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return docs.select("doc_id", "text", letters).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def label_words(docs: DataFrame, model: CRF) -> DataFrame:
    """Rows (doc_id, words): each word's place in the text's bytes, its language and the marginal."""
    shared, version = _share(docs.sparkSession, model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in pieces(batches):
            raw, offsets = utf8(batch.column("text"))
            data, starts, ends, before = words_of(raw, offsets)
            found = marginals(own, version, data, starts, ends, before)
            best = found.argmax(axis=1) if own.labels else np.zeros(0, np.int64)
            words = [[{"from": int(starts[w] - o), "to": int(ends[w] - o), "lang": own.labels[best[w]], "p": float(found[w, best[w]])} for w in range(a, b)] if own.labels else [] for a, b, o in zip(before[:-1], before[1:], offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("lang", pa.string()), ("p", pa.float64())])))], ["doc_id", "words"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, words array<struct<from: long, to: long, lang: string, p: double>>")
