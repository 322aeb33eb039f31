"""URL filters: host and path rules, and logistic regression on hashed character n-grams.

Method
  Rules name a host and the beginning of a path; a rule fits its host and all
  subdomains, the longest fitting rule decides (of equally long ones the first). Urls without a rule are judged
  by logistic regression on the presence of character n-grams (3 to 5) of
  host and path, hashed apart to 18 bits each, trained on the driver from a
  small labelled table: `LABELLED`, or a table (url, blocked) of at most
  `max_rows` rows. The weights, two megabytes, are broadcast. Host, path and rule are DataFrame expressions;
  n-grams are array arithmetic over blocks of Arrow buffers.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased;
path: from there up to `?`, `#` or the end. Defined results: a null or empty url, or
one without `://`, has an empty host and path, no rule, and the verdict of
their n-grams alone. Very long urls are judged whole. A score of exactly 0.5 blocks.
Repeated rows give repeated results; an empty table gives no rows; other columns are ignored, whatever their names;
a null page_id stays null. In training, rows without a url or label are left out and equal urls count each; an empty table gives a model that blocks all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.store import read_table, trimmed
from quern.llm.words import blocks

#: Host, path, verdict.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
MAX_ROWS = 20_000
BITS = 18
EPOCHS = 40
RATE, SHRINK = 0.3, 1e-3

#: Labelled urls: pages that are kept, and advertising, gambling, tracking, malware and spam.
_KEPT = """
    news.example.com/en/1024.html www.example.org/about library.example.edu/papers/1234 blog.example.com/2021/05/weather docs.example.org/guide/install
    science.example.edu/de/artikel/77 m.example.com/en/88?page=2 history.example.org/wiki/Grain journal.example.com/fr/301 wiki.example.org/es/5512/
    example.com/ www.example.net/contact school.example.edu/courses/biology garden.example.org/de/rosen recipes.example.com/bread/rye
    maps.example.org/city/lyon m.example.org/de/4410 www.example.com/en/2210/ blog.example.org/fr/902.html museum.example.edu/exhibits/bronze
    weather.example.com/es/lluvia theatre.example.org/programme/2020 www.example.edu/research/physics blog.example.net/post/first-snow archive.example.org/1998/letters
    forum.example.com/t/1882 support.example.com/faq#top m.example.edu/en/15?ref=x council.example.org/minutes/may trains.example.com/timetable/north
    www.example.org/fr/7/ m.example.com/es/640.html blog.example.edu/en/alumni music.example.com/albums/31 books.example.org/author/woolf
    www.example.com/de/impressum health.example.edu/advice/sleep photos.example.org/2019/harbour law.example.edu/cases/1204 m.example.net/fr/33
    hospital.example.org/visitors www.example.net/es/mapa blog.example.com/en/5?utm_source=feed farm.example.com/en/wheat choir.example.org/concerts
    www.example.edu/en/9981.html language.example.org/grammar/verbs m.example.org/fr/288#top data.example.edu/sets/rivers bakery.example.com/en/opening
    chess.example.org/games/77 www.example.com/fr/1450 birds.example.org/species/heron m.example.com/de/3320/ hiking.example.com/routes/alps
    poetry.example.org/en/sonnets blog.example.org/es/2007 www.example.org/en/terms stars.example.edu/nebula kids.example.org/stories/fox
    morgenrot.example.com/en/7312 www.lathermen.example.org/fr/118?page=2 m.thornhest.example.com/en/6040#top blog.aneltion.example.org/en/2877.html
    ostreau.example.com/de/401/ www.ingerblan.example.com/es/56 m.entheror.example.org/fr/9300 blog.sherriton.example.com/en/5021?utm_source=feed
    quenelle.example.org/fr/77.html www.ershenwald.example.com/de/8125#top m.oneable.example.org/es/3310/ thandring.example.com/en/690?page=2&ref=x
    blog.tarnessen.example.com/fr/2044 www.hionther.example.org/en/1576/ m.whitmore.example.com/en/48.html stillwater.example.org/de/903?utm_source=feed
    anterion.example.com/es/1207 www.tholen.example.org/en/3961 blog.reverent.example.org/de/5588.html m.theatre-arts.example.com/en/62?page=2&ref=x
"""
_BLOCKED = """
    spam-farm.example.org/en/113 ads.example.com/click?id=77 casino-bonus.example.com/win/bonus click-track.example.org/track/301 cheap-pills.example.com/buy-cheap/5512/
    free-spam.example.org/ads/banner adserver.example.com/redirect win-prize.example.org/free/download.exe seo-links.example.com/fr/114.html malware-host.example.org/casino/index.html
    www.casino-win.example.com/de/115/ m.free-bets.example.org/fr/340.html ads-track.example.net/win blog.cheap-meds.example.com/es/116?page=2&ref=x www.hot-deals-win.example.org/en/117#top
    online-casino.example.com/slots bets-online.example.net/odds/today pills-discount.example.org/order m.click-ads.example.com/en/5?utm_source=feed tracker-pixel.example.org/p.gif
    www.free-money.example.com/en/118?utm_source=feed loan-fast-cash.example.org/apply cheap-watches.example.com/replica poker-bonus.example.net/ads/show www.spam-links.example.org/en/119
    adclick.example.com/r/1 popunder-ads.example.net/show win-iphone.example.com/claim m.cheap-viagra.example.org/es/18 bitcoin-double.example.com/fr/120.html
    www.casino-royal-win.example.net/de/121/ track-ads.example.com/click?id=4 free-bonus-bets.example.org/en/31/ phishing-login.example.com/bank/verify cheap-tickets-win.example.net/es/122?page=2&ref=x
    slots-jackpot.example.org/play m.adtrack.example.com/en/123#top seo-spam.example.net/en/124?utm_source=feed crack-keygen.example.org/download www.pills-online.example.com/fr/5
    lottery-winner.example.com/claim/22 click-here-free.example.org/free/spins m.bets-win.example.com/en/125 banner-ads.example.net/728x90 warez-free.example.com/get
    casino-free-spins.example.org/fr/126.html www.ads-network.example.com/fr/19 cheap-loans.example.org/de/127/ free-download-win.example.net/exe m.spam-mail.example.com/jackpot
    www.click-bonus.example.org/es/128?page=2&ref=x betting-tips-win.example.com/fr/2 pharma-cheap.example.net/en/129#top track-click.example.org/en/130?utm_source=feed ads-pop.example.com/win
    free-gift-cards.example.com/en/7 m.casino-slots.example.org/en/131 malware-free-scan.example.net/fr/132.html cheap-pills-rx.example.com/de/133/ www.win-cash.example.org/de/1
    adult-cams.example.net/live www.adult-chat.example.com/ads/show xxx-adult.example.org/video/9 m.adult-dating.example.com/join
"""
#: (url, blocked)
LABELLED = tuple((f"https://{u}", label) for label, table in ((0, _KEPT), (1, _BLOCKED)) for u in table.split())
_URL_BYTES = 1 << 18


def grams(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct hashed n-grams of each host (low half) and path (high half)."""
    found = []
    for side, texts in ((0, hosts), (1 << BITS, paths)):
        texts = pc.binary_join_element_wise("^", texts, "$", "").cast(pa.large_binary())
        raw = np.frombuffer(texts.buffers()[2], np.uint8).astype(np.uint64)
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = raw[ends[0] : ends[-1]]
        row = np.repeat(np.arange(len(texts)), np.diff(ends))
        code = raw
        for n in range(2, 6):
            code = (code[:-1] << np.uint64(8)) | raw[n - 1 :]
            if n >= 3:
                inside = row[: len(code)] == row[n - 1 :]
                key = (code[inside] + np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
                found.append(row[: len(code)][inside] << (BITS + 1) | key.astype(np.int64) + side)
    pairs = np.unique(np.concatenate(found))
    return pairs >> (BITS + 1), pairs & ((2 << BITS) - 1)


def split_urls(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def find_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of its name and verdict; null if none does."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for name, start, verdict in reversed(sorted(rules, key=lambda r: -len(r[0] + r[1]))):  # the longest is asked first
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("name"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class Model:
    """Weights of host and path n-grams, as single precision."""

    def __init__(self, rows: list[tuple[str, str, int]], epochs: int = EPOCHS):
        """rows: host, path, whether blocked."""
        self.weights, self.bias = np.zeros(2 << BITS, np.float32), 0.0
        row, key = grams(pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())) if rows else (np.zeros(0, int),) * 2
        cuts = np.searchsorted(row, np.arange(len(rows) + 1))
        examples = [(key[a:b], r[2]) for r, a, b in zip(rows, cuts[:-1], cuts[1:], strict=True)]
        shuffled = np.random.default_rng(5)
        for _ in range(epochs):
            for i in shuffled.permutation(len(examples)).tolist():
                at, label = examples[i]
                scale = 1 / np.sqrt(max(1, len(at)))
                p = 1 / (1 + np.exp(-np.clip(self.weights[at].sum() * scale + self.bias, -30, 30)))
                self.weights[at] -= RATE * ((p - label) * scale + SHRINK * self.weights[at])
                self.bias -= RATE * 0.1 * (p - label)

    def score(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        """The probability that each url is to be blocked."""
        row, key = grams(hosts, paths)
        total = np.bincount(row, self.weights[key], len(hosts)) / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(hosts))))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "url", _URL_BYTES):
                score = model.value.score(batch.column("host"), batch.column("path"))
                verdict = pc.coalesce(batch.column("verdict"), pc.if_else(pa.array(score >= 0.5, pa.bool_()), "block", "allow"))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), verdict, pa.array(score, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "score"])

    return run


def train(labelled: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on a small table (url, blocked): the max_rows rows with the smallest hash of their url."""
    rows = labelled.where("url is not null and blocked is not null").orderBy(F.xxhash64("url"), "url", "blocked").limit(max_rows)
    return Model([tuple(r) for r in rows.select(*split_urls(F.col("url")), F.col("blocked").cast("int")).collect()])


def judge_urls(pages: DataFrame, model: Model | None = None, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row."""
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(model or train(spark.createDataFrame(LABELLED, "url string, blocked int")))
    host, path = split_urls(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"))
    found = rows.withColumn("found", find_rule(F.col("host"), F.col("path"), rules)).select("page_id", "url", "host", "path", F.col("found.name").alias("rule"), F.col("found.verdict").alias("verdict"))
    return found.mapInArrow(trimmed(_scored(shared)), "page_id long, host string, path string, rule string, verdict string, score double")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"))
