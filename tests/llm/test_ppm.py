import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import ppm
from quern.llm.langid import fold


def test_base_scores_and_probabilities(make):
    rows = [(i, f"the cat number {i % 7} sat on THE mat {'again ' * (i % 4)}") for i in range(60)] + [(70, None), (71, ""), (72, "Zebra zebra"), (72, "Zebra zebra"), (None, "no id"), (73, "w " * 20_000)]
    docs = make(*rows).withColumn("held_out", fold("doc_id", 5) == 1)
    got = ppm.ppm_scores(docs).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    words = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    total, kinds = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), total, round(sum(math.log10((c[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in words(t)), 4)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert ppm.ppm_scores(docs.where("false")).count() == 0
    assert ppm.ppm_scores(docs.withColumn("held_out", F.lit(True))).where("score < 0 AND train_tokens = 0").count() == len(rows)


@pytest.fixture
def trie():
    words = [b"the", b"then", b"that", b"a", b"banana", "été".encode(), b"xyzzy" * 4]
    symbol, slots, _ = ppm.contexts(words)
    order = np.repeat(np.arange(ppm.ORDER + 1), len(symbol))
    key, count = np.unique(np.stack([order, (slots * ppm.SYMBOLS + symbol).reshape(-1)]), axis=1, return_counts=True)
    return ppm.Trie(key[0], key[1], count)


def test_each_context_is_a_distribution(trie):
    _, slots, _ = ppm.contexts([b"the", b"thq", b"banana", b""])
    for i in range(slots.shape[1]):
        every = trie.log10(np.arange(ppm.SYMBOLS), np.repeat(slots[:, i : i + 1], ppm.SYMBOLS, axis=1))
        assert abs((10**every).sum() - 1) < 1e-9


def test_seen_spellings_are_likelier(trie):
    a, b, c = trie.words([b"banana", b"qqqqqq", b""])
    assert a > b and c < 0


def test_every_byte_is_scored_by_contexts_across_words(make):
    rows = [(i, f"the cat {i % 5} sat on the mat") for i in range(40)] + [(50, "mat the on sat 0 cat the"), (51, "the cat 0 sat on the mat"), (52, None), (53, "é new wörd")]
    docs = make(*rows).withColumn("held_out", F.col("doc_id") >= 50)
    symbol, slots, _ = ppm.contexts([t.encode() for i, t in rows if i < 50])
    order = np.repeat(np.arange(ppm.ORDER + 1), len(symbol))
    key, count = np.unique(np.stack([order, (slots * ppm.SYMBOLS + symbol).reshape(-1)]), axis=1, return_counts=True)
    want = dict(zip([i for i, _ in rows], ppm.Trie(key[0], key[1], count).words([(t or "").encode() for _, t in rows]), strict=True))
    for frequent in (ppm.FREQUENT_GRAMS, 20, 0):
        got = {r["doc_id"]: r["score"] for r in ppm.ppm_scores(docs, frequent_grams=frequent).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    assert got[51] > got[50] + 1  # the same words in another order


def test_grams_are_told_apart():
    code, first = ppm.grams(pa.array(["abcdefg", None, "", "bcdefg"]))
    assert np.diff(first).tolist() == [8, 1, 1, 7] and code[8] == code[9]
    assert code[6] == code[15] and code[5] != code[14]  # five symbols before g alike; before f not


def test_pieces_equal_whole_texts():
    r = random.Random(3)
    texts = pa.array([None, "", "a", "x" * 50, "".join(r.choice("abé ") for _ in range(333)), "end"], pa.string())
    code, first = ppm.grams(texts)
    for limit in (1, 7, 40, 1000):
        pieces = list(ppm.gram_pieces(texts, limit))
        assert np.concatenate([c for _, c in pieces]).tolist() == code.tolist()
        assert np.concatenate([o for o, _ in pieces]).tolist() == np.repeat(np.arange(len(texts)), np.diff(first)).tolist()
        assert all(len(c) <= 2 * limit + len(texts) for _, c in pieces)


def test_unbroken_words_of_megabytes(spark, make):
    r = random.Random(5)
    docs = make((1, "".join(r.choices("abcdefgh", k=3_000_000))), (2, "abc " * 10), (3, "x" * 2_000_000)).selectExpr("*", "doc_id = 3 AS held_out", "1 AS `row`", "2 AS gram", "3 AS word")
    got = {x["doc_id"]: x for x in ppm.ppm_scores(docs).collect()}
    assert got[1]["n_tokens"] == 2 and got[2]["n_tokens"] == 11 and got[3]["n_known"] == 1
    # letters drawn evenly from eight cost about log10(8) each
    assert abs(got[1]["score"] / 3_000_000 + math.log10(8)) < 0.05
