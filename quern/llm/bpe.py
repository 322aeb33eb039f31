"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Method
  Texts are cut into pieces at spaces; a piece is cut into words by the
  vocabulary's pattern. The distinct words of a block of texts (one task's
  whole texts, up to `block_chars` at a time) form one corpus of byte tokens
  with previous/next links. An inverted index maps each token pair, named by the rank
  its merge has, to the positions where it stands. Merges are replayed in
  rank order over the whole corpus; a merge updates only its two neighbours,
  whose new pairs enter the index. Encoded pieces are kept, up to a bounded number of bytes, and reused by the
  task's later blocks.

  Splitting at single spaces equals splitting the whole text by the default pattern
  unless a space stands between two white-space characters, or between one
  and the end; those texts, and all texts under another pattern, are split whole.

Defined results: a null text is empty and has no ids. Ids are what the
tiktoken library's encode_ordinary gives, for texts and single words of any length. Of equal pairs that
overlap, the left one merges first. Repeated rows give repeated results; an empty table gives no rows;
columns besides doc_id and text are ignored, whatever their names; a null doc_id stays null.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.store import read_table, trimmed

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BLOCK_CHARS = 2_000_000
#: Bytes of encoded pieces that a task keeps between blocks, and what one entry takes besides its texts.
KEPT_BYTES = 48_000_000
_ENTRY_BYTES = 150
_WINDOW = 256
_GLUED = re.compile(r"\s \s|\s \Z")


class Vocabulary:
    """Ranks of byte strings, and the rank of each pair of tokens that can merge."""

    def __init__(self, lines: bytes, pattern: str):
        self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        self.size = max(self.rank.values()) + 1
        self.bytes = [b""] * self.size
        for token, r in self.rank.items():
            self.bytes[r] = token
        self.pattern = regex.compile(pattern)
        self.splits_at_spaces = pattern == public_tokenizers.PATTERN
        self.byte_rank = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, r in self.rank.items():
            for i in range(1, len(token)):
                a, b = self.rank.get(token[:i]), self.rank.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * (self.size + 1) + b] = r
        self._keys = np.array(sorted(pairs), np.int64)
        self._ranks = np.array([pairs[k] for k in self._keys.tolist()], np.int64)

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges into; `size` where it can't."""
        want = left * (self.size + 1) + right
        at = np.minimum(np.searchsorted(self._keys, want), len(self._keys) - 1)
        return np.where(self._keys[at] == want, self._ranks[at], self.size)

    def plain(self, word: bytes) -> list[int]:
        """One word by itself, its lowest pair merged again and again."""
        parts = [self.rank[bytes([b])] for b in word]
        while len(parts) > 1:
            ranks = self.merges(np.array(parts[:-1]), np.array(parts[1:]))
            i = int(ranks.argmin())
            if ranks[i] == self.size:
                break
            parts[i : i + 2] = [int(ranks[i])]
        return parts


@cache
def vocabulary(lines: bytes, pattern: str) -> Vocabulary:
    return Vocabulary(lines, pattern)


def _joined(parts: list) -> np.ndarray:
    """Arrays of places and single places as one array."""
    single = [x for x in parts if isinstance(x, int)]
    return np.concatenate([*(x for x in parts if not isinstance(x, int)), np.array(single, np.int64)])


def replay(words: list[bytes], v: Vocabulary) -> list[bytes]:
    """Each word's ids as packed little-endian 32-bit numbers."""
    if not words:
        return []
    data = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words], np.int64)
    head = np.cumsum(size) - size
    n = len(data)
    token = np.append(v.byte_rank[data], v.size)  # place n stands for "no neighbour"
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[head + size - 1] = n
    before[head] = n
    rank = np.append(v.merges(token[:-1], token[after[:-1]]), v.size)
    alive, marked = np.ones(n, bool), np.zeros(n + 1, bool)
    odd: set[int] = set()  # words in which a later merge has a lower rank; done by themselves

    def merge(at: np.ndarray, r: int) -> np.ndarray:
        """Join each token in `at` with its right neighbour; the places whose pairs changed."""
        gone = after[at]
        beyond = after[gone]
        after[at] = beyond
        before[beyond] = at
        token[at] = r
        alive[gone] = False
        rank[gone] = v.size
        left = before[at]
        left = left[(left != n) & ~marked[left]]
        changed = np.concatenate([at, left])
        rank[changed] = v.merges(token[changed], token[after[changed]])
        low = changed[rank[changed] <= r]
        if len(low):
            again = low[rank[low] < r]
            odd.update((np.searchsorted(head, again, "right") - 1).tolist())
        return changed[rank[changed] < v.size]

    index: list[list[np.ndarray]] = [[] for _ in range(v.size // _WINDOW + 1)]

    def file(places: np.ndarray) -> None:
        """Enter places into the index under the window of their pair's rank."""
        window = rank[places] // _WINDOW
        order = np.argsort(window, kind="stable")
        places, window = places[order], window[order]
        cuts = np.flatnonzero(np.diff(window)) + 1
        for part, w in zip(np.split(places, cuts), window[np.concatenate([[0], cuts])].tolist() if len(window) else [], strict=False):
            index[w].append(part)

    file(np.flatnonzero(rank[:n] < v.size))
    for w in range(len(index)):
        if not index[w]:
            continue
        places = np.concatenate(index[w])
        index[w] = []
        places = places[(rank[places] // _WINDOW == w) & (rank[places] < v.size)]
        order = np.argsort(rank[places], kind="stable")
        places = places[order]
        ranks = rank[places]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        here = {int(part_rank): [part] for part, part_rank in zip(np.split(places, cuts), ranks[np.concatenate([[0], cuts])] if len(ranks) else [], strict=False)}
        later = []
        r = w * _WINDOW
        while here:
            r = min(here)
            at = np.sort(_joined(here.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            marked[at] = True
            chained = marked[after[at]]
            if chained.any():  # the same pair twice over one token: from the left, one at a time
                marked[at] = False
                changed = np.unique(np.concatenate([merge(np.array([p]), r) for p in at.tolist() if rank[p] == r]))
                changed = changed[rank[changed] < v.size]
            else:
                changed = merge(at, r)
                marked[at] = False
            soon = rank[changed] < (w + 1) * _WINDOW
            if soon.any():
                now = changed[soon]
                for p, new in zip(now.tolist(), rank[now].tolist(), strict=True):
                    here.setdefault(new, []).append(p)
                changed = changed[~soon]
            later.append(changed)
        if later:
            file(np.concatenate(later))

    kept = np.add.reduceat(alive, head, dtype=np.int64)
    ids = token[:-1][alive].astype("<u4").tobytes()
    ends = np.cumsum(kept) * 4
    out = [ids[a:b] for a, b in zip((ends - kept * 4).tolist(), ends.tolist(), strict=True)]
    for i in odd:
        out[i] = np.array(v.plain(words[i]), "<u4").tobytes()
    return out


class Encoder:
    """Encodes blocks of texts; keeps the pieces it has encoded, up to a bounded number of bytes."""

    def __init__(self, v: Vocabulary, kept_bytes: int = KEPT_BYTES):
        self.v, self.kept_bytes, self.held = v, kept_bytes, 0
        self.pieces: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.held > self.kept_bytes:
            self.pieces, self.held = {}, 0
        pieces, findall = self.pieces, self.v.pattern.findall
        whole = {i for i, t in enumerate(texts) if not self.v.splits_at_spaces or _GLUED.search(t)}
        fresh = {p for i, t in enumerate(texts) if i not in whole for p in t.split(" ")[1:] if p not in pieces}
        fresh = {p: findall(" " + p) for p in fresh}
        firsts = [findall(t if i in whole else t.split(" ", 1)[0]) for i, t in enumerate(texts)]
        words = dict.fromkeys(w for ws in (*fresh.values(), *firsts) for w in ws)
        raw = [w.encode() for w in words]
        known = [self.v.rank.get(b) for b in raw]
        done = iter(replay([b for b, r in zip(raw, known, strict=True) if r is None], self.v))
        for w, r in zip(words, known, strict=True):
            words[w] = next(done) if r is None else r.to_bytes(4, "little")
        for p, ws in fresh.items():
            pieces[p] = ids = b"".join([words[w] for w in ws])
            self.held += len(p) + len(ids) + _ENTRY_BYTES
        out = []
        for i, t in enumerate(texts):
            front = b"".join([words[w] for w in firsts[i]])
            out.append(front if i in whole else front + b"".join([pieces[p] for p in t.split(" ")[1:]]))
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.v.bytes.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _encoded(lines, pattern: str, block_chars: int, outputs: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(lines.value, pattern))

        def done(ids: list, texts: list) -> pa.RecordBatch:
            packed = encoder.encode(texts)
            back = [encoder.decode(p) for p in packed]
            columns = {
                "doc_id": pa.array(ids, pa.int64()),
                "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
            }
            if "ids" in outputs:
                columns["ids"] = pa.array([np.frombuffer(p, "<i4") for p in packed], pa.list_(pa.int32()))
            if "decoded" in outputs:
                columns["decoded"] = pa.array(back, pa.binary())
            return pa.RecordBatch.from_pydict(columns)

        ids, texts, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or "")
                held += len(texts[-1])
                if held >= block_chars:
                    yield done(ids, texts)
                    ids, texts, held = [], [], 0
        if texts:
            yield done(ids, texts)

    return run


def byte_bpe(docs: DataFrame, *, path: str | None = None, pattern: str | None = None, block_chars: int = BLOCK_CHARS, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the outputs asked for: ids array<int>, decoded binary.

    path: a rank file; the public multilingual one unless given. It is read on
    the driver and sent to the executors (under a megabyte).
    """
    spark = docs.sparkSession
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        lines = spark.sparkContext.broadcast(f.read())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", {n} {t}" for n, t in (("ids", "array<int>"), ("decoded", "binary")) if n in outputs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(_encoded(lines, pattern or public_tokenizers.PATTERN, block_chars, outputs)), schema)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(read_table(spark, sf_dir, "documents"), outputs=())
