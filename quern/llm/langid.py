"""Language identification by a string kernel.

Method
  The kernel of two texts counts the byte n-grams (blended spectrum: n from 2
  to 4, hashed) that occur in both, presence only, normalised to 1 for equal
  texts. Nystrom: texts are mapped to their kernel values with landmark
  texts, whitened by the landmarks' own kernel matrix; one-versus-rest ridge
  regression on that map is kernel ridge regression in the landmarks' span.
  Since the kernel is a dot product of presence vectors, landmarks, whitening
  and ridge weights fold into one matrix, and batches of whole texts are
  scored by one matrix product.

Training takes at most `rows_per_lang` rows of each language, those with the
smallest hash of their doc_id, and `MAX_ROWS` in all; beyond `MAX_LANGS` languages the most frequent are
learnt. The rows come from a hash threshold for each language, so no language is
gathered or ranked as a whole; they are turned into packed presence bits on
the executors (2 KB each), and the normal equations are summed over blocks of
them. Everything else reads whole texts.

Defined results: lang_pred is `und` with score 0 if text is null, empty or has no
letter, or if there was nothing to learn from. A null doc_id counts as the
empty text in the fold rule. Repeated rows give repeated results, and count as often in training, within the
bound. Ties go to the alphabetically first language. Very long texts are scored whole, one presence row each. An empty
table gives no rows. Columns besides doc_id, text and lang are ignored, or kept as they are by `with_language`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.store import read_table, trimmed
from quern.llm.words import blocks

ROWS_PER_LANG = 1000
MAX_ROWS, MAX_LANGS = 60_000, 1000
LANDMARKS = 256
RIDGE = 1e-2
BITS = 14
ORDERS = (2, 3, 4)
SHARPNESS = 6.0
UNKNOWN = "und"
_ROWS = 512  # texts in one presence matrix

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def fold(doc_id: str, parts: int):
    """crc32 of the id as text, modulo parts."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(parts))


def has_letter(texts: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))


def presence(texts: pa.Array) -> np.ndarray:
    """A row for each text: which hashed n-grams it has."""
    raw = [np.frombuffer(t, np.uint8) for t in pc.fill_null(texts, "").cast(pa.binary()).to_pylist()]
    out = np.zeros((len(raw), 1 << BITS), bool)
    for row, b in zip(out, raw, strict=True):
        b = _FOLD[b]
        code = b
        for n in range(2, max(ORDERS) + 1):
            if len(b) < n:
                break
            code = (code[:-1] << np.uint32(8)) | b[n - 1 :]
            if n in ORDERS:
                row[((code + np.uint32(n)) * np.uint32(2654435769)) >> np.uint32(32 - BITS)] = True
    return out


class Model:
    """Languages and the matrix that maps normalised presence to one score for each."""

    def __init__(self, packed: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        """packed: presence bits as np.packbits gives them, a row for each of langs."""
        self.langs = sorted(set(langs))
        self.weights = np.zeros((1 << BITS, len(self.langs)), np.float32)
        if not self.langs:
            return

        def unit(rows: np.ndarray) -> np.ndarray:
            x = np.unpackbits(rows, axis=1).astype(np.float32)
            return x / np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))

        marks = unit(packed[np.unique(np.linspace(0, len(packed) - 1, min(landmarks, len(packed))).astype(int))])
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        good = values > 1e-6 * values.max()
        whiten = vectors[:, good] / np.sqrt(values[good])
        left, right = np.zeros((good.sum(), good.sum())), np.zeros((good.sum(), len(self.langs)))
        names = np.array(langs)
        for a in range(0, len(packed), _ROWS):
            mapped = (unit(packed[a : a + _ROWS]) @ marks.T).astype(np.float64) @ whiten
            left += mapped.T @ mapped
            right += mapped.T @ np.where(names[a : a + _ROWS, None] == np.array(self.langs), 1.0, -1.0)
        ridge_weights = np.linalg.solve(left + ridge * len(packed) * np.eye(len(left)), right)
        self.weights = (marks.T @ (whiten @ ridge_weights)).astype(np.float32)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, best = [], np.zeros(len(texts))
        letters = has_letter(texts)
        for a in range(0, len(texts), _ROWS):
            part = texts.slice(a, _ROWS)
            if not self.langs:
                names += [UNKNOWN] * len(part)
                continue
            bits = presence(part)
            score = (bits.astype(np.float32) @ self.weights) / np.sqrt(np.maximum(1, bits.sum(axis=1, keepdims=True)))
            odds = np.exp(SHARPNESS * (score - score.max(axis=1, keepdims=True)))
            odds /= odds.sum(axis=1, keepdims=True)
            known = letters[a : a + len(part)]
            best[a : a + len(part)] = np.where(known, odds.max(axis=1), 0.0)
            names += [self.langs[i] if ok else UNKNOWN for i, ok in zip(score.argmax(axis=1).tolist(), known.tolist(), strict=True)]
        return names, best


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in blocks(whole, "text"):
            for a in range(0, batch.num_rows, _ROWS):
                part = batch.slice(a, _ROWS)
                packed = np.packbits(presence(part.column("text")), axis=1)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("order"), pa.array([r.tobytes() for r in packed], pa.binary())], ["lang", "order", "bits"])


def train(docs: DataFrame, *, rows_per_lang: int = ROWS_PER_LANG, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on rows (doc_id, text, lang) that have a text and a language."""
    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("order")
    rows = docs.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), order)
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("order").alias("ids")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()  # a row for each language
    each = max(1, min(rows_per_lang, MAX_ROWS // max(1, len(counts))))
    # each id is in with a chance of 2 * each + 100 in their number; then the first `each` of each language
    below = [(r["lang"], min(2**63 - 1, int((2 * each + 100) / max(1, r["ids"]) * 2**64) - 2**63)) for r in counts]
    limits = docs.sparkSession.createDataFrame(below, "lang string, below long")
    near = rows.join(F.broadcast(limits), "lang").where("order <= below").mapInArrow(trimmed(_bits), "lang string, order long, bits binary")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "bits"))).where(F.col("rank") <= each)
    found = ranked.select("order", "lang", "bits").toArrow().sort_by([("order", "ascending"), ("lang", "ascending"), ("bits", "ascending")])
    raw = b"".join(found.column("bits").to_pylist())
    return Model(np.frombuffer(raw, np.uint8).reshape(found.num_rows, (1 << BITS) // 8), found.column("lang").to_pylist(), landmarks, ridge)


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text"):
                names, score = model.value.predict(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def _known(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text"):
                if model.value.langs:
                    names, _ = model.value.predict(batch.column("text"))
                    keep = np.array([n != UNKNOWN for n in names], bool)
                else:
                    keep = has_letter(batch.column("text"))
                yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row; docs must have held_out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(_predicted(docs.sparkSession.sparkContext.broadcast(model))), "doc_id long, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that have a language, or a letter if nothing was learnt; all columns stay as they are."""
    return docs.mapInArrow(trimmed(_known(docs.sparkSession.sparkContext.broadcast(model))), docs.schema)


def learn_from_folds(docs: DataFrame) -> Model:
    """Training on the documents that op9 doesn't hold out."""
    return train(docs.where(fold("doc_id", 3) != 1))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs.withColumn("held_out", fold("doc_id", 3) == 1), learn_from_folds(docs))
