import random

import numpy as np
import pyarrow as pa

from quern.llm import langid

STEMS = {"aa": "kal mor ten vil sup", "bb": "zhu qix wub jyk pfo", "cc": "élan çoi früh ñan ßel"}


def corpus(r, n):
    return [(i, " ".join("".join(r.choices(STEMS[lang].split(), k=r.randint(1, 3))) for _ in range(r.randint(3, 60))), lang) for i, lang in ((i, r.choice(sorted(STEMS))) for i in range(n))]


def test_held_out_accuracy(make):
    rows = corpus(random.Random(8), 300)
    docs = make(*rows, (1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "", "cc"), (1003, "kalmor ten", None), (1003, "kalmor ten", None), (None, "wubjyk", "bb"))
    got = langid.identify(docs.withColumn("held_out", langid.fold("doc_id", 3) == 1), langid.learn_from_folds(docs)).collect()
    by = {r["doc_id"]: r for r in got}
    held = [by[i]["lang_pred"] == lang for i, _, lang in rows if by[i]["held_out"]]
    assert len(held) > 60 and np.mean(held) > 0.98
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000]["score"] == 0
    assert by[1003]["lang_pred"] == "aa" and by[None]["lang_pred"] == "bb" and len(got) == 306
    kept = langid.with_language(docs, langid.learn_from_folds(docs))
    assert kept.schema == docs.schema and kept.count() == 303


def test_nothing_to_learn_from(make, odd):
    model = langid.train(make((1, "a")).where("false"))
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("held_out", langid.fold("doc_id", 3) == 1), model).collect()} == {"und"}
    assert langid.identify(odd.where("false").withColumn("held_out", langid.fold("doc_id", 3) == 1), model).count() == 0


def test_the_folded_matrix_is_kernel_ridge_regression():
    texts = [t for _, t, _ in corpus(random.Random(9), 40)]
    langs = [lang for _, _, lang in corpus(random.Random(9), 40)]
    bits = langid.presence(pa.array(texts, pa.string())).astype(np.float32)
    x = bits.astype(np.float64) / np.sqrt(bits.sum(axis=1, keepdims=True))
    model = langid.Model(np.packbits(bits.astype(bool), axis=1), langs, landmarks=40, ridge=0.05)
    target = np.where(np.array(langs)[:, None] == np.array(model.langs), 1.0, -1.0)
    kernel = x @ x.T
    dual = kernel @ np.linalg.solve(kernel + 0.05 * 40 * np.eye(40), target)
    assert np.abs(x @ model.weights - dual).max() < 1e-3


def test_documents_stay_if_there_is_nothing_to_learn_from(make):
    docs = make((1, "kalmor ten", None), (2, "123 !!", None), (3, None, None), (4, "élan", None))
    kept = langid.with_language(docs, langid.learn_from_folds(docs))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4] and kept.schema == docs.schema


def test_many_languages_and_repeated_rows_stay_within_the_bounds(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_ROWS", 400)
    monkeypatch.setattr(langid, "MAX_LANGS", 40)
    sizes = []
    model = langid.Model
    monkeypatch.setattr(langid, "Model", lambda packed, langs, *a: sizes.append((len(packed), len(set(langs)))) or model(packed, langs, *a))
    docs = spark.range(30_000).selectExpr("CASE WHEN id < 20000 THEN 7 ELSE id END AS doc_id", "concat('word', id % 60, ' and', id % 60) AS text", "concat('l', id % 60) AS lang")
    learnt = langid.train(docs, rows_per_lang=50)
    assert sizes[0][0] <= 400 and sizes[0][1] == len(learnt.langs) == 40
    assert (1 << langid.BITS) // 8 * langid.ROWS_PER_LANG * 60 < 200e6  # bytes of sixty languages on the driver
