import random

import numpy as np
import pytest

from quern.llm import neardup
from quern.llm.store import Scratch
from quern.llm.words import mix


def brute(rows):
    """component and set size of each row, by all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    group = list(range(len(rows)))
    find = lambda x: x if group[x] == x else find(group[x])
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                group[find(i)] = find(j)
    group = [find(i) for i in range(len(rows))]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for (d, _), g in zip(rows, group, strict=True) if g == group[i] and d is not None]
        out.append((doc, len(sets[i]), min(ids, default=None) if sets[i] else doc))
    return out


def corpus(r):
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows = []
    for base in range(12):
        text = [word() for _ in range(r.choice((3, 8, 60, 300)))]
        for _ in range(r.choice((1, 2, 9))):
            copy = list(text)
            for _ in range(r.randint(0, max(1, len(text) // 25))):
                copy[r.randrange(len(copy))] = word()
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, rows[0][1].upper()), (903, rows[0][1].upper()), (None, rows[5][1]), (None, "alone here"), (904, "x " * 30_000)]
    return rows


def test_components_equal_brute_force(make):
    rows = corpus(random.Random(5))
    got = neardup.near_duplicates(make(*rows)).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(brute(rows), key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_empty_table(make):
    assert neardup.near_duplicates(make((1, "a")).where("false")).count() == 0


def test_large_near_copy_group_and_chain(make):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(60)]
    texts = []
    for _ in range(700):  # copies of one text, each with up to two changes: many aren't links, but all are reachable
        copy = list(base)
        for _ in range(r.randint(0, 2)):
            copy[r.randrange(len(copy))] = word()
        texts.append(copy)
    chain = [word() for _ in range(100)]
    for _ in range(30):  # each is a link to its neighbours only
        texts.append(list(chain))
        chain = chain[8:] + [word() for _ in range(8)]
    passage = [word() for _ in range(50)]
    texts += [passage + [word() for _ in range(25)] for _ in range(120)]  # a common passage, no links
    r.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = neardup.near_duplicates(make(*rows)).collect()
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == sorted(brute(rows))


def test_clashing_columns(make):
    docs = make((1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x")).selectExpr("*", "1 AS component_id", "2 AS kept", "3 AS n_shingles", "4 AS bands", "5 AS place")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in neardup.near_duplicates(docs).collect()}
    assert got == {1: (3, 1, True), 2: (3, 1, False), 3: (1, 3, True)}


def test_components_of_chains_and_stars(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 120)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(50)]
    parent = {x: x for p in links for x in p}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([tuple(x.to_bytes(2, "big") for x in p) for p in links], "a binary, b binary").repartition(5)
    scratch = Scratch(spark, "test")
    got = {int.from_bytes(row["class"], "big"): int.from_bytes(row["comp"], "big") for row in neardup.components(df, scratch).collect()}
    assert {x: got.get(x, x) for x in parent} == {x: find(x) for x in parent}
    assert not neardup.components(df.where("false"), scratch).collect()


@pytest.mark.parametrize("n", [1, 31, 32, 33, 300, 5000])
def test_parities_never_exceed_the_difference(n):
    rng = np.random.default_rng(n)
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    for m in {n, max(1, 3 * n // 4), n * 4 // 3}:
        b = np.unique(np.concatenate([a[: m * 9 // 10], rng.integers(0, 2**63, m - m * 9 // 10).astype(np.uint64)]))
        (la, xa, ha), (lb, xb, hb) = neardup.parities(a), neardup.parities(b)
        one, two = (ha if la > lb else xa), (hb if lb > la else xb)
        assert abs(la - lb) <= 1 and len(one) == len(two) and 64 * len(xa) >= 2 * n
        differ = sum(bin(int(v) & (2**64 - 1)).count("1") for v in one ^ two)
        assert differ <= len(np.setxor1d(a, b))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    m = 240
    pool = mix(rng.integers(0, 2**63, 1500).astype(np.uint64))
    for n, common in ((400, 300), (30, 20), (5, 5)):
        a, b = pool[:n], pool[n - common : 2 * n - common]
        true = common / (2 * n - common)
        x, y = neardup.superminhash(a, m), neardup.superminhash(b, m)
        assert abs((x == y).mean() - true) < 0.15
        assert (neardup.superminhash(a[::-1].copy(), m) == x).all()
    assert (neardup.band_keys(x, 48, 5) == neardup.band_keys(x.copy(), 48, 5)).all()


def group_around_one_text(r, n, words=150):
    """n texts, each one text with up to seven words changed: some are links of it, the others are not, and few of those are links of each other."""
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(words)]
    out = [base]
    while len(out) < n:
        copy = list(base)
        for _ in range(r.randint(1, 7)):
            copy[r.randrange(words)] = word()
        out.append(copy)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


def test_pairs_of_a_large_group_grow_with_its_size_only(make, monkeypatch):
    rows = group_around_one_text(random.Random(3), 600)
    settle, decided = Scratch.settle, []

    def counted(self, df, name):
        out = settle(self, df, name)
        if name == "pairs":
            decided.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "settle", counted)
    got = neardup.near_duplicates(make(*rows)).collect()
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == sorted(brute(rows))
    assert decided[-1] < len(rows) // 4, decided  # comparing all members of open buckets decided more than one pair a row


def test_links_of_far_members_meet(spark):
    r = random.Random(4)
    sets, of_class = [], {}
    for group in range(4):  # two clusters around different texts, which share a passage, and noise
        base = [r.getrandbits(62) for _ in range(r.choice((8, 40, 90)))]
        other = base[: len(base) * 2 // 3] + [r.getrandbits(62) for _ in range(len(base) // 3)]
        for _ in range(40):
            s = set(r.sample(b := r.choice((base, other)), len(b) - r.randint(0, len(b) // 5))) | {r.getrandbits(62) for _ in range(r.randint(0, len(b) // 5))}
            name = len(sets).to_bytes(2, "big")
            of_class[name] = group, s
            sets.append((name, sorted(s)))
    table = spark.createDataFrame(sets, "class binary, sh array<long>")
    least = {g: min(n for n, (other, _) in of_class.items() if other == g) for g, _ in of_class.values()}
    groups = spark.createDataFrame([(least[g], name, name, least[g]) for name, (g, _) in of_class.items()], "main binary, class binary, comp binary, pivot binary")  # each its own component
    differences = neardup._differences(groups, neardup._ranked(table, groups.select("class")), 75).cache()
    near = {bytes(x["class"]) for x in differences.where("near").collect()}
    met = {frozenset((bytes(x["x"]), bytes(x["y"]))) for x in neardup._sharing(differences, 75).collect()}
    link = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    pivot = {bytes(x["class"]): bytes(x["pivot"]) for x in groups.collect()}
    assert near == {c for c in of_class if link(of_class[c][1], of_class[pivot[c]][1])}
    links = [(a, b) for a in of_class for b in of_class if a < b and of_class[a][0] == of_class[b][0] and link(of_class[a][1], of_class[b][1])]
    far = [(a, b) for a, b in links if not (a in near and b in near)]
    assert far and all(frozenset(x) in met for x in far)
