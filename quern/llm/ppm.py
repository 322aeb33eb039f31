"""Language-model scores by prediction by partial matching over byte contexts.

Method
  A text is the run of its UTF-8 bytes, white space included, and one end. Every
  byte and the end is predicted from the `ORDER` symbols before it, across
  words; before a text stand ends. At each order, the longest first, a symbol counted c of n in its
  context, among t different ones, has probability (2c - 1) / 2n, and the escape to
  the next shorter context t / 2n (method D). Symbols already offered by longer
  contexts are excluded from the shorter ones. Below order 0 all symbols left are
  equally likely. The score is the sum of log10 over the whole text.

  A probability depends on a gram alone: a symbol and the `ORDER` before it, a
  number to base 257. So all texts are counted as rows (gram, count), unhashed,
  as many as the corpus has; the shorter contexts are sums of them. What a
  symbol costs after an escape from its context follows from the sums of that context (n, t,
  and n of its symbols in the next shorter one), so the orders are joined from
  0 upwards, each row with one shorter row, at most 257 rows a key. Texts then meet
  the grams' log probabilities: the most frequent grams, a bounded number, are
  broadcast, all others joined, so none is so common that its rows crowd the join.

Tokens, known ones and the base score are of words: runs of bytes other than white space, A-Z
lower-cased, and one end for each text, counted and joined in the same way.
The base score is the sum over tokens of log10((c+0.5)/(N+0.5*(V+1))).

Defined results: a null, empty or wordless text is its end alone as a word: one token. A null
doc_id counts as the empty text in the fold rule. Very long texts and words are read piece by piece. Repeated rows give repeated
results and count as often. Ties among frequent grams and words change no score. An empty table gives no rows. Columns besides
doc_id, text and held_out are ignored, whatever their names.
Without training rows N and V are 0, and the model is uniform.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.langid import fold
from quern.llm.store import read_table, settle, trimmed
from quern.llm.words import Words, blocks

ORDER = 5
SYMBOLS = 257
END = 256
_COUNT_BYTES = 4 << 20
#: Grams are made of so many bytes at a time; longer texts are read piece by piece.
_GRAM_BYTES = 1 << 20
#: So many of the most frequent words are broadcast with their counts, and don't take part in the join.
FREQUENT = 50_000
#: Longer words are never broadcast.
_SHORT = 64
#: At most so many of the most frequent grams are broadcast with their log probabilities.
FREQUENT_GRAMS = 1 << 19
_HELD = 1 << 21
_TABLE_BITS = 21


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every symbol of these texts, and where each text's begin."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    first = off - off[0] + np.arange(len(off))
    symbol = np.full(first[-1], END, np.int64)
    inside = np.ones(len(symbol), bool)
    inside[first[1:] - 1] = False
    symbol[inside] = raw
    code, back = symbol.copy(), symbol
    head = first[:-1]
    for n in range(1, ORDER + 1):
        back = np.concatenate([[END], back[:-1]])[: len(symbol)]  # the n-th symbol back
        back[head] = END
        code += back * SYMBOLS**n
    return code, first


def gram_pieces(texts: pa.Array, limit: int = _GRAM_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(whose text it is, gram) of every symbol of these texts, in order, about `limit` symbols at a time."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()))
    a = 0
    while a < len(texts):
        b = max(a + 1, a + int(np.searchsorted(np.cumsum(sizes[a:]), limit, "right")))
        if b > a + 1 or sizes[a] <= limit:
            code, first = grams(texts.slice(a, b - a))
            yield np.repeat(np.arange(a, b), np.diff(first)), code
        else:
            raw = texts[a].as_py()
            raw = memoryview(raw.encode() if isinstance(raw, str) else raw)
            for at in range(0, len(raw), limit):
                before = min(at, ORDER)  # the symbols that the piece's first ones are predicted from
                code, _ = grams(pa.array([bytes(raw[at - before : at + limit])], pa.binary()))
                code = code[before : None if at + limit >= len(raw) else -1]
                yield np.full(len(code), a), code
        a = b


def contexts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols to be predicted for these texts, the contexts of each by order, and whose text each is."""
    code, first = grams(pa.array(words, pa.binary()))
    slots = np.stack([code % SYMBOLS ** (n + 1) // SYMBOLS for n in range(ORDER + 1)])
    return code % SYMBOLS, slots, np.repeat(np.arange(len(words)), np.diff(first))


class Trie:
    """The model of a small corpus in memory, read symbol by symbol: what `gram_scores` must agree with."""

    def __init__(self, order: np.ndarray, key: np.ndarray, count: np.ndarray):
        self.tables: list[dict[int, dict[int, int]]] = [{} for _ in range(ORDER + 1)]
        for n, k, c in zip(order.tolist(), key.tolist(), count.tolist(), strict=True):
            self.tables[n].setdefault(k // SYMBOLS, {})[k % SYMBOLS] = c

    def log10(self, symbol: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """The log10 probability of each symbol; column i of slots holds its contexts."""
        return np.array([self._one(s, slots[:, i].tolist()) for i, s in enumerate(symbol.tolist())])

    def _one(self, symbol: int, slots: list[int]) -> float:
        gone: set[int] = set()
        out = 0.0
        for n in range(ORDER, -1, -1):
            left = {s: c for s, c in self.tables[n].get(slots[n], {}).items() if s not in gone}
            if symbol in left:
                return out + math.log10((2 * left[symbol] - 1) / (2 * sum(left.values())))
            if left:
                out += math.log10(len(left) / (2 * sum(left.values())))
                gone |= left.keys()
        return out - math.log10(SYMBOLS - len(gone))

    def words(self, words: list[bytes]) -> np.ndarray:
        """The log10 probability of each text with its end."""
        symbol, slots, owner = contexts(words)
        return np.bincount(owner, self.log10(symbol, slots), len(words))


def _vocabulary(words: Words) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Hashes and bytes of a block's distinct words, and which of them each word is."""
    keys, one, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
    size = words.end[one] - words.start[one]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    spelt = words.low[np.repeat(words.start[one] - offsets[:-1], size) + np.arange(offsets[-1])]
    names = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(spelt.tobytes())])
    return keys, names, which.reshape(-1)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, c): each block's distinct words and how often its training texts have them."""
    for whole in batches:
        for batch in blocks(whole, "text", _COUNT_BYTES):
            words = Words(batch.column("text"))
            _, names, which = _vocabulary(words)
            learn = np.repeat(np.asarray(batch.column("learn")), np.diff(words.first))
            yield pa.RecordBatch.from_arrays([names, pa.array(np.bincount(which, learn, len(names)).astype(np.int64))], ["word", "c"])


def _frequent(shared):
    """For each text one row of sums over its frequent words, and a row (word, n) for each other word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, base = shared.value
        for whole in batches:
            for batch in blocks(whole, "text"):
                rows, words = batch.column("row"), Words(batch.column("text"))
                own, names, which = _vocabulary(words)
                owner = np.repeat(np.arange(len(rows)), np.diff(words.first))
                at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
                often = (keys[at] == own) if len(keys) else np.zeros(len(own), bool)
                known = often[which]
                mine, place = owner[known], at[which[known]]
                n = len(rows)
                sums = [np.bincount(mine, minlength=n).astype(np.int64), np.bincount(mine, base[place], n)]
                pairs, count = np.unique(owner[~known] * max(1, len(own)) + which[~known], return_counts=True)
                rest = pairs // max(1, len(own))
                mark = pc.binary_join_element_wise(pa.array([b" "] * n, pa.binary()), rows, b"")  # no word holds a space, so none is met
                zeros = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.array(np.zeros(len(pairs)), kind)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([rows, rows.take(pa.array(rest))]), pa.concat_arrays([mark, names.take(pa.array(pairs % max(1, len(own))))]),
                        pa.array(np.concatenate([np.zeros(n, np.int64), count])), zeros(sums[0], pa.int64()), zeros(sums[1], pa.float64()),
                    ],
                    ["row", "word", "n", "k", "b"],
                )

    return run


def _summed(parts: list[np.ndarray]) -> np.ndarray:
    """Rows gram, count and count in training, each gram once."""
    gram, m, c = np.concatenate(parts, axis=1)
    gram, which = np.unique(gram, return_inverse=True)
    total = lambda x: np.bincount(which.reshape(-1), x, len(gram)).astype(np.int64)
    return np.stack([gram, total(m), total(c)])


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, m, c): a task's grams, how often all its texts have them, and its training texts."""
    out = lambda held: pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["gram", "m", "c"])
    held, new, size = np.zeros((3, 0), np.int64), [], 0
    for whole in batches:
        for owner, code in gram_pieces(whole.column("text")):
            both, n = np.unique(code * 2 + np.asarray(whole.column("learn"))[owner], return_counts=True)
            new.append(np.stack([both >> 1, n, n * (both & 1)]))
            size += len(both)
            if size >= _HELD // 2:
                held, new, size = _summed([held, *new]), [], 0
                if held.shape[1] >= _HELD:
                    yield out(held)
                    held = np.zeros((3, 0), np.int64)
    yield out(_summed([held, *new]))


def gram_scores(counts: DataFrame) -> DataFrame:
    """counts (gram, m, c; each gram once) and score: log10 of the gram's last symbol after those before it."""
    key = lambda n: F.col("gram") % F.lit(SYMBOLS ** (n + 1))
    lowest = counts.groupBy(key(0).alias("key")).agg(F.sum("c").alias("c")).collect()  # at most 257 rows
    kinds, total = sum(r["c"] > 0 for r in lowest), sum(r["c"] for r in lowest)
    spark = counts.sparkSession
    below = spark.createDataFrame([(r["key"], r["c"], total, kinds, -math.log10(max(1, SYMBOLS - kinds))) for r in lowest], "key long, c long, n long, t long, low double")
    for order in range(1, ORDER + 1):
        own = counts.select("gram", "m", "c", F.col("gram").alias("key")) if order == ORDER else counts.groupBy(key(order).alias("key")).agg(F.sum("c").alias("c"))
        short = below.select(F.col("key").alias("under"), F.col("c").alias("lc"), F.col("n").alias("ln"), F.col("t").alias("lt"), F.col("low").alias("ll"))
        rows = own.withColumn("under", F.col("key") % F.lit(SYMBOLS**order)).join(short, "under")
        context = Window.partitionBy(F.expr(f"key div {SYMBOLS}"))
        met = F.col("c") > 0
        rows = rows.withColumns({"n": F.sum("c").over(context), "t": F.count(F.when(met, 1)).over(context), "x": F.sum(F.when(met, F.col("lc")).otherwise(0)).over(context)})
        # without the symbols that this order offers, the shorter context has ln - x counts of lt - t kinds
        left = 2 * (F.col("ln") - F.col("x"))
        escape = F.when(F.col("lt") > F.col("t"), F.log10((F.col("lt") - F.col("t")) / left)).otherwise(0.0)
        low = F.when(met, 0.0).when(F.col("lc") > 0, F.log10((2 * F.col("lc") - 1) / left)).otherwise(escape + F.col("ll"))
        below = rows.withColumn("low", low)
    size = 2 * F.col("n")
    escape = F.when(F.col("t") > 0, F.log10(F.col("t") / size)).otherwise(0.0)
    return below.select("gram", "m", "c", F.when(met, F.log10((2 * F.col("c") - 1) / size)).otherwise(escape + F.col("low")).alias("score"))


def _often(table: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows above a count that at most `limit` rows reach; no task gives more of them than there are."""
    size = F.floor(F.log2(count) * 16)
    sizes = sorted(map(tuple, table.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # at most 1024 rows
    least, held = 1024, 0
    for reached, n in sizes:
        held += n
        if held > limit:
            break
        least = reached
    return table.where(size >= least)


def _frequent_grams(table: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent grams, at most `limit`, sorted, and their scores."""
    often = _often(table, "m", limit).select("gram", "score").toArrow()
    gram, score = (np.asarray(often.column(i).combine_chunks()) for i in range(2))
    order = np.argsort(gram)
    return gram[order], score[order]


def _hashed(gram: np.ndarray) -> np.ndarray:
    return (gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def _gram_sums(shared):
    """For each text one row with the sum of its frequent grams, and a row for each other gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, score = shared.value
        slot = np.zeros(1 << _TABLE_BITS, np.int32)
        slot[_hashed(keys)] = np.arange(len(keys))
        for batch in batches:
            rows = batch.column("row")
            apart = -1 - (np.frombuffer(b"".join(rows.to_pylist()), np.int64)[::2] & ((1 << 62) - 1))  # no gram, and not one key for all texts
            for owner, code in gram_pieces(batch.column("text")):
                if len(keys):
                    at = slot[_hashed(code)]
                    met = keys[at] == code
                    rest = np.flatnonzero(~met)  # not broadcast, or another gram has its slot
                    found = np.minimum(np.searchsorted(keys, code[rest]), len(keys) - 1)
                    also = keys[found] == code[rest]
                    at[rest[also]], met[rest[also]] = found[also], True
                else:
                    at, met = np.zeros(len(code), np.int32), np.zeros(len(code), bool)
                mine, own = np.arange(owner[0], owner[-1] + 1), owner[~met]
                sums = np.bincount(owner[met] - owner[0], score[at[met]], len(mine)) if met.any() else np.zeros(len(mine))
                columns = [np.concatenate([apart[mine], code[~met]]), np.concatenate([sums, np.zeros(len(own))])]
                yield pa.RecordBatch.from_arrays([rows.take(pa.array(np.concatenate([mine, own]))), *map(pa.array, columns)], ["row", "gram", "s"])

    return run


def ppm_scores(docs: DataFrame, frequent: int = FREQUENT, frequent_grams: int = FREQUENT_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row; docs must have held_out."""
    sc = docs.sparkSession.sparkContext
    row = F.concat(*(F.unhex(F.lpad(F.hex(F.xxhash64(*c)), 16, "0")) for c in (("doc_id", "text"), (F.lit(1), "text", "doc_id")))).alias("row")  # 128 bits
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", row)
    texts = docs.select(row, (~F.col("held_out")).alias("learn"), F.col("text").cast("string").alias("text"))
    table = settle(texts.select("learn", "text").mapInArrow(trimmed(_word_counts), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")
    ends = ids.where(~F.col("held_out")).count()
    sums = table.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    total, distinct = (sums[0] or 0) + ends, sums[1] + (ends > 0)
    floor = total + 0.5 * (distinct + 1)

    counts = texts.select("learn", "text").mapInArrow(trimmed(_gram_counts), "gram long, m long, c long").groupBy("gram").agg(F.sum("m").alias("m"), F.sum("c").alias("c"))
    scored = settle(gram_scores(settle(counts, "grams")), "scored")
    shared = sc.broadcast(_frequent_grams(scored, frequent_grams))
    spelt = texts.select("row", "text").mapInArrow(trimmed(_gram_sums(shared)), "row binary, gram long, s double")
    spelt = spelt.join(scored.select("gram", "score"), "gram", "left").groupBy("row").agg(F.sum(F.col("s") + F.coalesce("score", F.lit(0.0))).alias("s"))

    # the most frequent words, at most `frequent`, are counted where they stand; all others by a join
    often = _often(table.where(f"c > 0 AND length(word) <= {_SHORT}"), "c", frequent).collect()
    keys = Words(pa.array([bytes(r["word"]) for r in often], pa.binary())).hashes()
    order, c = np.argsort(keys), np.array([r["c"] for r in often], np.float64)
    shared = sc.broadcast((keys[order], np.log10((c[order] + 0.5) / floor)))
    parts = texts.select("row", "text").mapInArrow(trimmed(_frequent(shared)), "row binary, word binary, n long, k long, b double")
    joined = parts.join(table, "word", "left")
    known = F.coalesce(F.col("c"), F.lit(0)) > 0
    base = F.log10((F.coalesce(F.col("c"), F.lit(0)) + 0.5) / F.lit(floor))
    rare = lambda x: F.when(F.col("n") > 0, F.col("n") * x).otherwise(F.lit(0.0))
    sums = joined.groupBy("row").agg(
        F.sum(F.col("n") + F.col("k")).alias("w"), F.sum(F.col("k") + F.when(known, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("b") + rare(base)).alias("b")
    )
    copies = ids.groupBy("row").agg(F.count(F.lit(1)).alias("copies"))
    sums = sums.join(spelt, "row").join(copies, "row")
    part = lambda c: F.coalesce(F.col(c) / F.col("copies"), F.lit(0.0))
    whole = lambda c: F.coalesce(F.expr(f"{c} div copies"), F.lit(0))
    return ids.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        (whole("w") + 1).alias("n_tokens"),
        (whole("k") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (part("b") + F.lit(math.log10((ends + 0.5) / floor))).alias("base_score"),
        part("s").alias("score"),
    )


def op6_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return ppm_scores(docs.withColumn("held_out", fold("doc_id", 5) == 1))
