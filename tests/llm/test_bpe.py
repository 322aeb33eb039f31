import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quern.llm.bpe import VOCABULARY, Encoder, byte_bpe, replay, vocabulary


@pytest.fixture(scope="module")
def v():
    with open(public_tokenizers.path(VOCABULARY), "rb") as f:
        return vocabulary(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(v):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.rank, special_tokens={})


def test_ids_are_those_of_the_library(v, library):
    r = random.Random(7)
    texts = ["", "  a", "a  ", "a   b \n c\n\n d", "aaaaaaaaaaaa aaaa", "abababababab", "日本語 12 ３", "<|endoftext|>", "'s don't I'LL", "\x1c \x1d a \x85 b", "\t \t", "x" * 5000]
    texts += ["".join(r.choice("ab  \n\t.,'1é日 ths😀") for _ in range(r.randint(0, 40))) for _ in range(1500)]
    encoder = Encoder(v)
    for text, packed in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
        assert encoder.decode(packed) == text.encode()


def test_replay_equals_merging_each_word_alone(v):
    r = random.Random(3)
    words = ["".join(r.choice("etaoinsh") for _ in range(r.randint(1, 30))).encode() for _ in range(800)] + [b"a" * 99]
    assert [np.frombuffer(p, "<u4").tolist() for p in replay(words, v)] == [v.plain(w) for w in words]


def test_odd_rows(odd, library):
    got = [r.asDict() for r in byte_bpe(odd, block_chars=100_000).collect()]
    assert len(got) == 9
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == texts[r["doc_id"]].encode()
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_empty_table(make):
    assert byte_bpe(make((1, "a")).where("false")).count() == 0
