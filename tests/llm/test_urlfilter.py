import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import urlfilter
from quern.llm.urlfilter import LABELLED, RULES, Model, find_rule, grams, judge_urls, split_urls, train


@pytest.fixture(scope="module")
def model(spark):
    return train(spark.createDataFrame(LABELLED, "url string, blocked int"))


def score(model, host, path):
    return float(model.score(pa.array([host], pa.string()), pa.array([path], pa.string()))[0])


CASES = [
    ("https://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", ("example.net/en/", "allow")),
    ("http://example.net/EN/", "example.net", "/EN/", ("net/", "block")),
    ("http://x.example.com/de/1", "x.example.com", "/de/1", ("example.com/de/", "block")),
    ("http://badexample.com/de/1", "badexample.com", "/de/1", None),
    ("http://a.org/fr/", "a.org", "/fr/", ("org/fr/", "allow")),
    ("http://a.net", "a.net", "", None),
    ("http://a.net?x=/en/", "a.net", "", None),
    ("http://Ä.net/b#c", "Ä.net", "/b", ("net/", "block")),
    ("no scheme.net/", "", "", None),
    (None, "", "", None),
    ("a://b://c/d", "b:", "//c/d", None),
    ("x\ny://h\n.net/\np\n?q", "h\n.net", "/\np\n", ("net/", "block")),
]


def test_urls_and_rules(spark):
    host, path = split_urls(F.col("url"))
    rows = spark.createDataFrame([(c[0],) for c in CASES], "url string").select("url", host.alias("host"), path.alias("path"))
    got = {r["url"]: r for r in rows.withColumn("rule", find_rule(F.col("host"), F.col("path"))).collect()}
    for url, h, p, rule in CASES:
        assert (got[url]["host"], got[url]["path"]) == (h, p)
        assert (got[url]["rule"] and tuple(got[url]["rule"])) == rule


def by_hand(url):
    """host, path and rule, character by character."""
    at = (url or "").find("://")
    if at < 0:
        return "", "", None
    host, path, part = "", "", 0
    for c in url[at + 3 :]:
        if c in "?#":
            break
        part = part or c == "/"
        if part:
            path += c
        else:
            host += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    best = None
    for name, start, verdict in RULES:
        if (host == name or host[-len(name) - 1 :] == "." + name) and path[: len(start)] == start and (best is None or len(name + start) > len(best[0])):
            best = name + start, verdict
    return host, path, best


def test_random_urls_equal_brute_force(spark, model):
    r = random.Random(6)
    parts = ["http", "://", "net", "example", ".", ".com", ".net", ".org", "/", "/en/", "/de/", "/fr/", "?", "#", "A", "é", " ", "casino", "-win"]
    urls = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(600)]
    urls += ["http://" + "".join(r.choice(parts[2:]) for _ in range(r.randint(0, 9))) for _ in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = judge_urls(pages, model).collect()
    assert len(got) == len(urls)
    for x in got:
        host, path, rule = by_hand(urls[x["page_id"]])
        assert (x["host"], x["path"], x["rule"]) == (host, path, rule and rule[0])
        assert abs(x["score"] - score(model, host, path)) < 1e-6
        assert x["verdict"] == (rule[1] if rule else "block" if x["score"] >= 0.5 else "allow")


def test_grams_equal_a_loop():
    hosts, paths = ["news.example.com", "", "é.x", "a"], ["/en/1", "", "/", "aaaaaa"]
    row, key = grams(pa.array(hosts, pa.string()), pa.array(paths, pa.string()))
    for i in range(4):
        want = set()
        for side, text in ((0, hosts[i]), (1 << urlfilter.BITS, paths[i])):
            raw = f"^{text}$".encode()
            for n in (3, 4, 5):
                for j in range(len(raw) - n + 1):
                    code = int.from_bytes(raw[j : j + n], "big") + (n << 56)
                    want.add(side + (code * 0x9E3779B97F4A7C15 % 2**64 >> 64 - urlfilter.BITS))
        assert sorted(key[row == i].tolist()) == sorted(want)


def test_the_model_separates_its_table_and_unseen_urls(spark, model):
    rows = judge_urls(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(LABELLED)], "page_id long, url string"), model, rules=()).collect()
    assert sum((x["verdict"] == "block") == bool(LABELLED[x["page_id"]][1]) for x in rows) == len(LABELLED)
    assert score(model, "www.casino-spam.example.org", "/win/now") > 0.5 > score(model, "news.example.edu", "/en/77.html")


def test_held_out_urls(spark):
    table = [(u, b) for i, (u, b) in enumerate(LABELLED) if i % 4]
    model = train(spark.createDataFrame(table, "url string, blocked int"))
    rest = [(i, u) for i, (u, _) in enumerate(LABELLED) if i % 4 == 0]
    rows = judge_urls(spark.createDataFrame(rest, "page_id long, url string"), model, rules=()).collect()
    assert np.mean([(x["verdict"] == "block") == bool(LABELLED[x["page_id"]][1]) for x in rows]) >= 0.9


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, 5, "h"), (2, "", 6, "h"), (2, "", 6, "h"), (None, "http://x.net/a", 7, "h"), (3, "http://" + "a" * 500_000 + ".org/q", 8, "h")], "page_id long, url string, score int, host string")
    got = {r["page_id"]: r for r in judge_urls(pages).collect()}
    assert got[1]["host"] == got[2]["path"] == "" and got[1]["rule"] is None and got[None]["verdict"] == "block" and len(got[3]["host"]) == 500_004
    assert judge_urls(pages).count() == 5 and judge_urls(pages.where("false")).count() == 0
    labelled = spark.createDataFrame([("http://a.b/x", 1), ("http://c.d/y", 0), (None, 1), ("http://e.f", None)], "url string, blocked int")
    model = train(labelled)
    assert score(model, "a.b", "/x") > 0.5 > score(model, "c.d", "/y")
    assert score(train(labelled.where("false")), "a.b", "/x") == 0.5
    assert isinstance(Model([]).bias, float)
