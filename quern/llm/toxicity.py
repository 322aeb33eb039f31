"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Method
  Features are the presence of words, word pairs and pairs with one word
  between, hashed to 24 bits; words are runs of letters, digits and non-ASCII
  bytes with A-Z lower-cased. A word also counts by its first 4, 5 and 6 bytes,
  so that inflected forms share their evidence. FTRL-proximal keeps a learning rate for each
  coordinate and sets weights to exactly zero unless their evidence exceeds
  the L1 strength, so the fitted model is a short sorted list of features and
  weights, which is broadcast; scoring reads whole texts.

Training takes at most `rows[label]` labelled documents of each label, those with
the smallest hash of their doc_id, and of these, in the order of the hash, as many as have `MAX_FEATURES`
features together: a bounded sample. A document's features
number at most 2^24, whatever its length.

Defined results: empty and null texts get the score of the bias alone. A null
label trains nothing; of repeated labels the largest counts, and of rows that
repeat a doc_id one is learnt from, the same whatever their order. Ties of the hash go by features. A null doc_id
counts as the empty text in the fold rule and has no label. Very long texts are scored whole. Repeated rows give
repeated results; an empty table gives no rows; columns besides doc_id and text (and toxic of labels) are ignored, whatever their names. With nothing to
learn from every score is 0.5 less a hair: predicted is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.langid import fold
from quern.llm.store import read_table, settle, trimmed
from quern.llm.words import PUNCTUATION, Words, blocks, draws, mix

#: Training rows by label.
ROWS = {0: 7000, 1: 3000}
MAX_FEATURES = 40_000_000
BITS = 24
EPOCHS = 6
STEMS = (4, 5, 6)
_BLOCK_BYTES = 1 << 20
_PAIR = draws(4, 31)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word, stem, pair and skip pair, repeats included."""
    words = Words(texts, PUNCTUATION)
    h = words.hashes()
    row = np.repeat(np.arange(len(texts)), np.diff(words.first))
    rows, keys = [row], [h]
    for index, stem in words.stems(STEMS):
        rows.append(row[index])
        keys.append(stem)
    for gap in (1, 2):
        same = row[gap:] == row[:-gap]
        pair = mix(h[:-gap] * _PAIR[0] + h[gap:] * _PAIR[1] + np.uint64(gap))
        rows.append(row[gap:][same])
        keys.append(pair[same])
    return np.concatenate(rows), (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int32)


class Model:
    """Sorted features, their weights, and the bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias
        self.filter = np.zeros(1 << 16, bool)
        self.filter[keys & 0xFFFF] = True

    def score(self, texts: pa.Array) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        if len(self.keys):
            row, key = features(texts)
            maybe = self.filter[key & 0xFFFF]
            row, key = row[maybe], key[maybe]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            pairs = np.unique(row[found].astype(np.int64) * len(self.keys) + at[found])
            np.add.at(total, pairs // len(self.keys), self.weights[pairs % len(self.keys)])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(rows: list[np.ndarray], labels: list[int], *, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0, epochs: int = EPOCHS) -> Model:
    """FTRL-proximal over documents given as arrays of distinct features."""
    z, n = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    bias, bias_n = -1e-9, 0.0
    for _ in range(epochs):
        for at, label in zip(rows, labels, strict=True):
            za, na = z[at], n[at]
            root = np.sqrt(na)
            w = np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + root) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - label
            after = na + g * g
            z[at] = za + g - (np.sqrt(after) - root) / alpha * w
            n[at] = after
            bias_n += g * g
            bias -= alpha * g / (beta + bias_n**0.5)
    keys = np.flatnonzero((z > l1) | (z < -l1))
    zk = z[keys].astype(np.float64)
    weights = -(zk - np.sign(zk) * l1) / ((beta + np.sqrt(n[keys])) / alpha + l2)
    return Model(keys.astype(np.int32), weights, bias)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in blocks(whole, "text", _BLOCK_BYTES):
            row, key = features(batch.column("text"))
            pairs = np.unique(row.astype(np.int64) << BITS | key)
            cuts = np.searchsorted(pairs >> BITS, np.arange(batch.num_rows + 1))
            packed = [(pairs[a:b] & ((1 << BITS) - 1)).astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("toxic"), pa.array(packed, pa.binary())], ["order", "toxic", "features"])


def train(docs: DataFrame, labels: DataFrame, *, rows: dict[int, int] = ROWS, **options) -> Model:
    """Fit on the documents that labels (doc_id, toxic) marks; options are those of `fit`."""
    order = F.xxhash64(F.col("doc_id").cast("string"))
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen, counts = [], dict(map(tuple, known.groupBy("toxic").agg(F.count(F.lit(1))).where(F.col("toxic").isin(list(rows))).collect()))
    for label, limit in rows.items():
        # each id is in with a chance of 2 * limit + 100 in their number, so that tasks give few to choose from
        below = min(2**63 - 1, int((2 * limit + 100) / max(1, counts.get(label, 0)) * 2**64) - 2**63)
        best = known.where(F.col("toxic") == label).withColumn("order", order).where(F.col("order") <= below).orderBy("order", "doc_id").limit(limit)
        chosen += [tuple(r) for r in best.select("doc_id", "toxic", "order").collect()]  # at most limit
    picked = docs.sparkSession.createDataFrame(chosen, "doc_id {}, toxic int, order long".format(labels.schema["doc_id"].dataType.simpleString()))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("text", "toxic", "order")
    made = texts.mapInArrow(trimmed(_feature_rows), "order long, toxic int, features binary")
    one = F.min(F.struct(F.xxhash64("features").alias("tie"), F.length("features").alias("bytes"), "features")).alias("x")
    made = settle(made.groupBy("order", "toxic").agg(one).select("order", "toxic", "x.tie", "x.bytes", "x.features"), "features")
    held, last = 0, None
    for r in made.select("order", "tie", "bytes").orderBy("order", "tie").collect():  # a row for each chosen document
        held += r["bytes"] // 4
        if held > MAX_FEATURES and last is not None:
            break
        last = r["order"]
    if last is None:
        return fit([], [], **options)
    found = made.where(F.col("order") <= F.lit(last)).select("order", "tie", "toxic", "features").toArrow().sort_by([("order", "ascending"), ("tie", "ascending"), ("toxic", "ascending")])
    return fit([np.frombuffer(f.as_buffer(), "<i4") for f in found.column("features")], found.column("toxic").to_pylist(), **options)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text", _BLOCK_BYTES):
                score = model.value.score(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array(score >= 0.5, pa.bool_()).cast(pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; docs must have held_out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(_scored(docs.sparkSession.sparkContext.broadcast(model))), "doc_id long, held_out boolean, score double, predicted int")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = train(docs, labels.where(fold("doc_id", 5) != 0))
    return toxicity(docs.withColumn("held_out", fold("doc_id", 5) == 0), model)
