import random

import corpus_pipeline


def test_every_stage_takes_effect(spark, make, tmp_path):
    words = lambda seed, n: " ".join(f"w{(seed * 7919 + i * i) % 9973}x{seed}" for i in range(n))
    item = words(99, 30)
    a = words(1, 80)
    rows = [(i, words(i + 10, 60), "en") for i in range(20)]
    rows += [(50, a, "en"), (51, a, "en"), (52, a + " more", "en"), (60, None, "en"), (61, "123 456", "en"), (70, words(5, 50) + " " + item, "en"), (80, words(6, 40) + " password=abcdefghijkl99", "en")]
    docs = make(*rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        columns = left.columns
        left = stage(spark, left, str(tmp_path))
        seen[name] = {r["doc_id"] for r in left.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert left.columns == columns
        if name == "secret_scan":
            assert [r["text"].endswith(" [SECRET]") and r["n_chars"] == len(r["text"]) for r in left.where("doc_id = 80").collect()] == [True]
    everything = {r[0] for r in rows}
    assert seen["language_id"] == everything - {60, 61}
    assert seen["near_dedup"] == seen["language_id"] - {51, 52}
    assert seen["decontamination"] == seen["near_dedup"] - {70}
    assert seen["byte_bpe"] == seen["secret_scan"] == seen["decontamination"]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in got.collect()} == seen["byte_bpe"] and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"} == set(got.columns)


def test_queries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_odd_rows_and_clashing_columns_of_every_stage(spark, make, odd, tmp_path):
    clashes = "keep_id", "quern_spans", "spans", "known", "runs", "row", "class", "comp", "bands", "place", "held_out", "n_tokens"
    extra = [f"'{c}' AS `{c}`" for c in clashes if c not in odd.columns]
    docs = odd.union(make((None, None), (None, "letters here"), (None, "letters here"), (8, "x" * 300_000), (9, "token=abcdefghijkl12 one two"))).selectExpr("*", *extra)
    spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        rows = left.collect()
        assert left.columns == docs.columns and all(r[c] == c for r in rows for c in clashes if c not in odd.columns)
        seen.append(sorted(str(r["doc_id"]) for r in rows))
    # null, empty and blank texts go; repeated rows stay together; a null id counts like any other
    assert seen[0] == sorted(["4", "4", "None", "5", "6", "7", "None", "None", "8", "9"])
    assert seen[2] == sorted(set(seen[1]) - {"5"}) or "5" not in seen[2]
    assert corpus_pipeline.STAGES[-1][1](spark, left, str(tmp_path)).count() == len(seen[-1])


def test_empty_tables(spark, make, tmp_path):
    make((1, "a")).where("false").select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_of_a_large_group_decides_few_pairs(spark, make, monkeypatch):
    from quern.llm.store import Scratch
    from test_neardup import brute, group_around_one_text

    rows = group_around_one_text(random.Random(6), 600)
    settle, decided = Scratch.settle, []

    def counted(self, df, name):
        out = settle(self, df, name)
        if name == "pairs":
            decided.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "settle", counted)
    left = corpus_pipeline.near_dedup(spark, make(*rows), "")
    assert {r["doc_id"] for r in left.collect()} == {doc for doc, _, comp in brute(rows) if doc == comp}
    assert decided[-1] < len(rows) // 4, decided
