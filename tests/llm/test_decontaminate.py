import random

from quern.llm.decontaminate import Index, contained_items, decontaminated, size_bounds


def words(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_every_containment_is_found(spark, make):
    r = random.Random(1)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnop")
    items = [(i, " ".join(word() for _ in range(r.choice((5, 9, 20, 45))))) for i in range(30)] + [(98, None), (99, ""), (97, "only three words"), (0, "a repeated id " * 3)]
    docs = [(100, None), (101, ""), (102, "only three words"), (103, "only three words more")]
    for i in range(80):
        text = [word() for _ in range(r.randint(0, 400))]
        for _, item in r.sample(items[:30], 2):
            part = item.split()
            part = part[: max(1, int(len(part) * r.choice((1, 0.9, 0.8, 0.5))))]
            text[len(text) // 2 : len(text) // 2] = [p.upper() for p in part]
        docs.append((i, " ".join(text)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((d, i, len(words(x)), len(words(x) & words(t))) for d, t in docs for i, x in items if words(x) and 100 * len(words(x) & words(t)) >= 75 * len(words(x)))
    for block in (4_000_000, 40):
        got = sorted((r["doc_id"], r["item_id"], r["n_item"], r["n_common"]) for r in contained_items(make(*docs), benchmark, block_shingles=block).collect())
        assert got == want and len(want) > 40
    hit = {d for d, *_ in want}
    frame = make(*docs)
    kept = decontaminated(frame, benchmark)
    assert kept.schema == frame.schema and sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _ in docs if d not in hit)


def test_odd_rows_and_empty_tables(spark, make, odd):
    benchmark = spark.createDataFrame([(1, "a b c d e f"), (None, "one")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in contained_items(odd, benchmark).collect() if r["item_id"] is not None)
    assert got == [(5, 1)]
    assert contained_items(odd, benchmark.where("false")).count() == 0
    assert contained_items(odd.where("false"), benchmark).count() == 0
    assert decontaminated(odd, benchmark.where("false")).count() == 9


def test_partitions_grow_by_half():
    assert size_bounds(14).tolist() == [1, 2, 3, 4, 6, 9, 13, 19]
    assert len(Index([], 75).keys) == 0
