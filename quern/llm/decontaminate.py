"""Benchmark decontamination: size-partitioned MinHash containment search, exactly verified.

Method
  A test item is its set of five-word shingles (`words.shingles`). Items are
  partitioned by set size, with upper bounds growing by about a half. Within
  a partition each item is indexed by its m MinHash minima (the m smallest
  hashes of its set), m being one more than the largest number of shingles
  an item of that size can miss at the threshold. So a document that contains
  enough of an item holds at least one of its minima, whatever the document's
  length: the search has no false negatives. Documents look all their shingles
  up in the index, and every candidate is decided by exact containment:
  100 |item and document| >= 75 |item|.

The items of one block (at most `block_shingles` shingles and one item more) are broadcast;
more items than that are searched in further blocks over the same documents, each block's result kept as a table.

Defined results: a null, empty or blank item or document matches nothing. One with
fewer than five words has its whole word sequence as its only shingle, so such an item is found in documents of exactly those words. Very long
documents and items are whole sets. Items found at equal containment are all listed. Repeated
rows, of items or documents, give repeated results. Empty tables give no matches. Columns besides ids and
text are ignored, or kept as they are by `decontaminated`, whatever their names; null ids stay null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.store import read_table, settle, trimmed
from quern.llm.words import SHINGLE, Words, blocks, shingles

PERCENT = 75
BLOCK_SHINGLES = 4_000_000
_FILTER_BITS = 22


def size_bounds(largest: int) -> np.ndarray:
    """Upper bounds of the size partitions: 1, 2, 3, 4, 6, 9, 13, ..."""
    bounds = [1]
    while bounds[-1] < largest:
        bounds.append(bounds[-1] + max(1, bounds[-1] // 2))
    return np.array(bounds)


class Index:
    """The MinHash minima of a block of items, by size partition, and their full sets."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        sizes = np.array([len(s) for s in sets], np.int64)
        bounds = size_bounds(int(sizes.max(initial=1)))
        upper = bounds[np.searchsorted(bounds, sizes)]
        minima = upper * (100 - percent) // 100 + 1
        keys = [s[:m] for s, m in zip(sets, minima.tolist(), strict=True)]  # sets are sorted, so these are the smallest
        owner = np.repeat(np.arange(len(sets)), [len(k) for k in keys])
        keys = np.concatenate([*keys, np.zeros(0, np.uint64)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.keys & np.uint64((1 << _FILTER_BITS) - 1)] = True

    def search(self, texts: pa.Array, k: int) -> list[tuple[int, int, int]]:
        """(row, item, shingles in common) of all sufficient containments."""
        sh, at = shingles(Words(texts), k)
        maybe = np.flatnonzero(self.filter[sh & np.uint64((1 << _FILTER_BITS) - 1)])
        low, high = np.searchsorted(self.keys, sh[maybe]), np.searchsorted(self.keys, sh[maybe], "right")
        hits = high - low
        rows = np.repeat(np.searchsorted(at, maybe, "right") - 1, hits)
        items = self.owner[np.repeat(low - (np.cumsum(hits) - hits), hits) + np.arange(hits.sum())]
        out = []
        for row in np.unique(rows).tolist():
            own = sh[at[row] : at[row + 1]]
            for item in np.unique(items[rows == row]).tolist():
                want = self.sets[item]
                both = int(np.isin(want, own).sum())
                if 100 * both >= self.percent * len(want):
                    out.append((row, item, both))
        return out


def _item_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sh, at = shingles(Words(batch.column("text")), k)
            sets = [np.unique(sh[a:b]).view(np.int64) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("item_id").cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["item_id", "sh"])

    return run


def _indexes(benchmark: DataFrame, percent: int, k: int, block_shingles: int) -> Iterator[tuple[list, Index]]:
    """The items in blocks of bounded size."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    names, sets, held = [], [], 0
    for item, sh in rows.mapInArrow(trimmed(_item_sets(k)), "item_id long, sh array<long>").toLocalIterator():
        if not sh:
            continue
        names.append(item)
        sets.append(np.sort(np.array(sh, np.int64).view(np.uint64)))
        held += len(sh)
        if held >= block_shingles:
            yield names, Index(sets, percent)
            names, sets, held = [], [], 0
    yield names, Index(sets, percent)


def _matches(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, index = shared.value
        for whole in batches:
            for batch in blocks(whole, "text"):
                found = index.search(batch.column("text"), k)
                if found:
                    rows, items, both = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").cast(pa.int64()).take(pa.array(rows, pa.int64())),
                            pa.array([names[i] for i in items], pa.int64()),
                            pa.array([len(index.sets[i]) for i in items], pa.int64()),
                            pa.array(both, pa.int64()),
                        ],
                        ["doc_id", "item_id", "n_item", "n_common"],
                    )

    return run


def _clean(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, index = shared.value
        for whole in batches:
            for batch in blocks(whole, "text"):
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _, _ in index.search(batch.column("text"), k)]] = False
                yield batch.filter(pa.array(keep))

    return run


def contained_items(docs: DataFrame, benchmark: DataFrame, *, percent: int = PERCENT, k: int = SHINGLE, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, item_id, n_item, n_common, containment): a row for each item that a document contains."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, n_item long, n_common long"
    found = lambda block: rows.mapInArrow(trimmed(_matches(spark.sparkContext.broadcast(block), k)), schema)
    indexes = _indexes(benchmark, percent, k, block_shingles)
    block, after = next(indexes), next(indexes, None)
    out = found(block) if after is None else settle(found(block), "contained")
    while after is not None:
        out = out.union(settle(found(after), "contained"))
        after = next(indexes, None)
    return out.withColumn("containment", F.col("n_common") / F.col("n_item"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, percent: int = PERCENT, k: int = SHINGLE, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The documents that contain no item; all columns stay as they are."""
    spark = docs.sparkSession
    for block in _indexes(benchmark, percent, k, block_shingles):
        docs = docs.mapInArrow(trimmed(_clean(spark.sparkContext.broadcast(block), k)), docs.schema)
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_SHINGLES_SQL = """
    SELECT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM (SELECT {id} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table})
"""
OP2_SQL = f"""
    WITH item AS (SELECT DISTINCT id, s FROM ({_SHINGLES_SQL.format(id="item_id", table="benchmark")})),
         sizes AS (SELECT id, count(*) AS n FROM item GROUP BY id),
         doc AS (SELECT DISTINCT id, s FROM ({_SHINGLES_SQL.format(id="doc_id", table="documents")}) WHERE s IN (SELECT s FROM item)),
         met AS (SELECT doc.id AS doc_id, item.id AS item_id, count(*) AS n_common FROM doc JOIN item USING (s) GROUP BY ALL)
    SELECT doc_id, item_id, n AS n_item, n_common, n_common / n AS containment
    FROM met JOIN sizes ON sizes.id = met.item_id WHERE 100 * n_common >= 75 * n
"""
