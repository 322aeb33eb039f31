import math
import random

import numpy as np
import pyarrow as pa

from quern.llm import toxicity
from quern.llm.langid import fold


def corpus(r, n):
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows, labels = [], []
    for i in range(n):
        text = [word() for _ in range(r.randint(5, 120))]
        bad = r.random() < 0.3
        if bad:
            text[r.randrange(len(text))] = r.choice(("grunk!", "Grunkable", "zorbish,"))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark, make):
    rows, labels = corpus(random.Random(4), 900)
    docs = make(*rows)
    known = spark.createDataFrame([*labels, (None, 1), (5, None), (10_000, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, known.where(fold("doc_id", 5) != 0))
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs.withColumn("held_out", fold("doc_id", 5) == 0), model).collect()}
    held = [(got[i]["predicted"], t) for i, t in labels if got[i]["held_out"]]
    assert len(held) > 120 and np.mean([p == t for p, t in held]) > 0.97
    assert len(model.keys) < 3000
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_odd_rows(spark, make, odd):
    nothing = toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.toxicity(odd.withColumn("held_out", fold("doc_id", 5) == 0), nothing).collect()
    assert len(got) == 9 and {r["predicted"] for r in got} == {0}
    assert toxicity.toxicity(odd.where("false").withColumn("held_out", fold("doc_id", 5) == 0), nothing).count() == 0


def test_features_do_not_cross_texts():
    row, key = toxicity.features(pa.array(["alpha beta", "gamma", None, "alpha, BETA!"], pa.string()))
    of = lambda i: sorted(key[row == i].tolist())
    assert of(0) == of(3) and len(of(0)) == 2 + 1 + 1 and len(of(1)) == 2 and of(2) == []


def scalar_ftrl(rows, labels, alpha=1.0, beta=1.0, l1=4.0, l2=1.0, epochs=6):
    """One coordinate after the other, as published."""
    z, n, bias, bias_n = {}, {}, -1e-9, 0.0

    def weight(i):
        if abs(z.get(i, 0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for at, label in zip(rows, labels, strict=True):
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - label
            for i in at:
                sigma = (math.sqrt(n.get(i, 0) + g * g) - math.sqrt(n.get(i, 0))) / alpha
                z[i] = z.get(i, 0) + g - sigma * w[i]
                n[i] = n.get(i, 0) + g * g
            bias_n += g * g
            bias -= alpha * g / (beta + math.sqrt(bias_n))
    return {i: weight(i) for i in z if weight(i)}, bias


def test_fit_equals_scalar_ftrl():
    r = random.Random(2)
    labels = [int(r.random() < 0.4) for _ in range(300)]
    rows = [np.array(sorted({r.randrange(40) + 40 * (label and r.random() < 0.6) for _ in range(12)}), np.int32) for label in labels]
    model = toxicity.fit(rows, labels)
    weights, bias = scalar_ftrl([x.tolist() for x in rows], labels)
    assert model.keys.tolist() == sorted(weights) and 5 < len(weights) < 80
    assert np.allclose(model.weights, [weights[i] for i in sorted(weights)], atol=1e-3) and abs(model.bias - bias) < 1e-3


def test_repeated_rows_and_long_texts_stay_within_the_bounds(spark, monkeypatch):
    docs = spark.range(5000).selectExpr("id % 3 AS doc_id", "concat('word', id % 50, ' other') AS text", "1 AS features", "2 AS `order`")
    known = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, labels: seen.append((len(rows), sum(map(len, rows)))))
    toxicity.train(docs, known)
    monkeypatch.setattr(toxicity, "MAX_FEATURES", 12)
    toxicity.train(docs, known)
    assert seen[0][0] == 3 and 0 < seen[1][0] < 3 and seen[1][1] <= 12
