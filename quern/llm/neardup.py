"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find.

Method
  1. Each text becomes its set of five-word shingles (`words.shingles`). A
     class is a distinct set, named by 128 bits; exact copies share a class and
     are never paired.
  2. SuperMinHash: the rank of an element in round j is j plus a uniform
     fraction, and lands in the j-th bin of the element's own permutation.
     Rounds stop as soon as every bin has a value from a round already done,
     since later rounds can only give larger ranks.
  3. Signatures are cut into bands. Classes with an equal band meet in a
     bucket. First each class meets one class only: the smallest of its
     largest bucket. Only buckets that the resulting components don't yet join are looked at
     again: in each of two turns, members outside the bucket's largest
     component meet one member of it. At last the buckets still open are taken together by their largest component: of all
     members only those meet whose differences from one member, the pivot, share a token that
     links must share (`_differences`).
  4. Pairs are first held against an exact bound: sizes, and the parities of
     how many shingles fall into each of at least 2n cells, whose number of
     differences can't exceed the symmetric difference. Every pair that is
     left is decided on full sets: 100 |A and B| >= 75 |A or B|.
  5. Links are merged by union-find within partitions and by neighbour minimum and pointer
     jumping between them; no link ever goes to the driver. Later links are merged as links between components.

The sets of the classes that share a bucket are made by one further scan of the texts, and kept as a table.
A bitmap of fixed size tells that scan which documents may be needed.

Defined results: a null text, or one without words, has n_shingles 0 and is a component
of its own. A text of one to four words is a single shingle. Very long texts are
whole sets like any other. Rows are never merged: a repeated row gives a repeated result. A
null doc_id is treated like any value, but component_id is the smallest
non-null doc_id of the component (null if it has none). Ties of candidates go to the smaller class name, which
changes no component. An empty table gives no rows. Columns besides
doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.store import Scratch, read_table, trimmed
from quern.llm.words import SHINGLE, Words, blocks, draws, mix, shingles

BANDS, ROWS = 48, 5
PERCENT = 75
#: Turns in which classes outside a bucket's largest component meet one of its members.
TURNS = 2
#: The bitmap of documents to be read again has 2^this bits, whatever their number.
BITMAP_BITS = 23

_SIGNATURE_SCHEMA = "doc_id long, n_shingles long, class binary, bands array<long>"
_SET_SCHEMA = "class binary, n int, level int, bits array<long>, half array<long>, sh array<long>"


def superminhash(elements: np.ndarray, m: int) -> np.ndarray:
    """The signature of a set of distinct 64-bit elements: round << 32 | fraction for each of m bins."""
    best = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    if not len(elements):
        return best
    seeds = draws(m, 21)
    order = None
    row = np.arange(len(elements))
    for j in range(m):
        x = mix(elements ^ seeds[j])
        rank = (x & np.uint64(0xFFFFFFFF)) | np.uint64(j << 32)
        k = (((x >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64) + j
        if j == 0:
            first, bins = k, k
        else:
            if order is None:
                order = np.tile(np.arange(m, dtype=np.uint16), (len(elements), 1))
                order[row, first], order[:, 0] = 0, first
            bins = order[row, k].astype(np.int64)
            order[row, k] = order[:, j]
        np.minimum.at(best, bins, rank)
        if int(best.max()) >> 32 <= j:
            break
    return best


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    weights = draws(bands * rows, 22).reshape(bands, rows)
    return mix((signature.reshape(bands, rows) * weights).sum(axis=1, dtype=np.uint64) + draws(bands, 23)).view(np.int64)


def class_key(elements: np.ndarray) -> bytes:
    """A 128-bit name of a sorted set."""
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def parities(elements: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """level, the parities of the numbers of elements in 64 * 2^level cells, packed, and those of half as many cells."""
    level = max(0, (2 * len(elements) - 1).bit_length() - 6)
    cells = 64 << level
    odd = np.bincount((mix(elements) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    pack = lambda x: np.packbits(x.astype(np.uint8), bitorder="little").view(np.int64)
    return level, pack(odd), pack(odd[: cells // 2] ^ odd[cells // 2 :]) if level else np.zeros(0, np.int64)


def _signatures(bands: int, rows: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text"):
                sh, at = shingles(Words(batch.column("text")), k)
                sizes, classes, keys = [], [], []
                for a, b in zip(at[:-1], at[1:], strict=True):
                    own = np.unique(sh[a:b])
                    sizes.append(len(own))
                    classes.append(class_key(own) if len(own) else None)
                    keys.append(band_keys(superminhash(own, bands * rows), bands, rows) if len(own) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "class", "bands"],
                )

    return run


def _sets(k: int, bitmap):
    """class, its size, parities and sorted shingles: of rows whose place the bitmap has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(bitmap.value, np.uint8)
        for whole in batches:
            place = np.asarray(whole.column("place"))
            whole = whole.filter(pa.array((marks[place >> 3] >> (place & 7)) & 1 == 1, pa.bool_()))
            for batch in blocks(whole, "text"):
                sh, at = shingles(Words(batch.column("text")), k)
                own = [np.unique(sh[a:b]) for a, b in zip(at[:-1], at[1:], strict=True) if b > a]
                marked = [parities(s) for s in own]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([class_key(s) for s in own], pa.binary()),
                        pa.array([len(s) for s in own], pa.int32()),
                        pa.array([m[0] for m in marked], pa.int32()),
                        *(pa.array([m[i] for m in marked], pa.list_(pa.int64())) for i in (1, 2)),
                        pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64())),
                    ],
                    ["class", "n", "level", "bits", "half", "sh"],
                )

    return run


def _local_union_find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each partition's links as one link per member to the smallest member of its tree."""
    parent: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for frame in frames:
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
            a, b = find(bytes(a)), find(bytes(b))
            if a != b:
                parent[max(a, b)] = min(a, b)
    out = [(x, root) for x in list(parent) if (root := find(x)) != x]
    yield pd.DataFrame(out, columns=["a", "b"], dtype=object)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(class, comp) for the classes in links (a, b); comp is the smallest class reachable.

    Union-find inside partitions first; what is left goes through rounds of neighbour minimum plus
    pointer jump. Labels only ever fall, so a round that changes none is the last. A class without a row is its own component.
    """
    forest = scratch.settle(links.mapInPandas(trimmed(_local_union_find), "a binary, b binary"), "forest")
    both = forest.union(forest.select("b", "a"))
    start = both.groupBy("a").agg(F.min("b").alias("n")).select(F.col("a").alias("class"), F.least("a", "n").alias("comp"))
    labels = scratch.settle(start, "labels")
    while True:
        near = both.join(labels.select(F.col("class").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels["class"] == near["a"]).select("class", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("class").alias("comp"), F.col("comp").alias("over"))
        after = step.join(jump, "comp", "left").select("class", "was", F.least("comp", "over").alias("comp"))
        after = scratch.settle(after, "labels")
        scratch.drop(labels)
        if after.where("comp <> was").isEmpty():
            scratch.drop(forest)
            return after.select("class", "comp")
        labels = after.select("class", "comp")
        scratch.paths[id(labels)] = scratch.paths.pop(id(after))


def _possible(x: str, y: str, percent: int) -> Column:
    """Whether sizes and parities of the classes with these prefixes leave the threshold possible. Never false for a link."""
    n, level, bits, half = ([F.col(p + name) for p in (x, y)] for name in ("n", "level", "bits", "half"))
    sizes = (n[0] * 100 >= n[1] * percent) & (n[1] * 100 >= n[0] * percent)
    one = F.when(level[0] > level[1], half[0]).otherwise(bits[0])
    two = F.when(level[1] > level[0], half[1]).otherwise(bits[1])
    differ = F.aggregate(F.zip_with(one, two, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, c: a + c)
    near = differ * (100 + percent) <= (n[0] + n[1]) * (100 - percent)
    return sizes & F.when(F.abs(level[0] - level[1]) > 1, True).otherwise(near)


def _ranked(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """class, n, ones, sh: the shingles of classes, rarest among them first, and how many of them are in no other class."""
    tokens = sets.join(classes.distinct(), "class", "left_semi").select("class", F.explode("sh").alias("t"))
    common = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    sorted_ = tokens.join(common, "t").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("s"))
    return sorted_.select("class", F.size("s").alias("n"), F.size(F.filter("s", lambda x: x["df"] == 1)).alias("ones"), F.col("s.t").alias("sh"))


def _differences(groups: DataFrame, ranked: DataFrame, percent: int) -> DataFrame:
    """groups (main, class, comp, pivot) with n, the size d of the class's difference D from the pivot, whether it is near (a link of the pivot), and `tokens`.

    A pair is a link if and only if |Dx ^ Dy| <= L = c (nx + ny), where c = (100 - percent) / (100 + percent). Its differences then share at
    least o = (dx + dy - L) / 2 tokens, so in any one order the first shared token has at least o tokens from there on in both.
    Two near classes need no pair, for both are linked to the pivot. If one of two isn't near, then o > 0: its d is over c (nx + np),
    and ny <= np + dy. So a near class needs no tokens behind the place with d * percent / (100 + percent) left, and
    any class at most n (100 - percent) / percent + 1. The order: what the pivot lacks, rarest first, then what it alone has, commonest first.
    tokens leaves out those that no other class has, which come first.
    """
    of_pivot = groups.select("main", F.col("pivot").alias("class")).distinct().join(ranked, "class").select("main", F.col("n").alias("pn"), F.col("sh").alias("psh"))
    d = groups.join(ranked, "class").join(of_pivot, "main")
    d = d.withColumn("all", F.concat(F.array_except("sh", "psh"), F.array_except(F.reverse("psh"), "sh"))).withColumn("d", F.size("all").cast("long"))
    d = d.withColumn("near", F.col("d") * (100 + percent) <= (F.col("n") + F.col("pn")) * (100 - percent))
    most = F.when(F.col("near"), F.expr(f"d - d * {percent} div {100 + percent}")).otherwise(F.least(F.col("d"), F.expr(f"n * {100 - percent}L div {percent} + 1")))
    kept = F.slice("all", F.col("ones") + 1, F.greatest(most - F.col("ones"), F.lit(0)).cast("int"))
    return d.select("main", "class", "comp", "pivot", F.col("n").cast("long").alias("n"), "d", "near", "ones", kept.alias("tokens"))


def _sharing(differences: DataFrame, percent: int) -> DataFrame:
    """(x, y) of one main and different components whose differences share a token that a link must share."""
    rows = differences.select("main", "class", "comp", "n", "d", "near", "ones", F.posexplode("tokens").alias("at", "t"))
    rows = rows.withColumn("left", F.col("d") - F.col("ones") - F.col("at"))
    side = lambda p: rows.select("main", "t", *(F.col(c).alias(p + c) for c in ("class", "comp", "n", "d", "near", "left")))
    c = F.col
    slack = (c("xn") + c("yn")) * (100 - percent)
    shared = 2 * (100 + percent) * F.least("xleft", "yleft") >= (c("xd") + c("yd")) * (100 + percent) - slack
    once = c("ynear") | (c("xclass") < c("yclass"))
    close = F.abs(c("xd") - c("yd")) * (100 + percent) <= slack
    met = side("x").where(~c("xnear")).join(side("y"), ["main", "t"]).where((c("xcomp") != c("ycomp")) & once & close & shared)
    return met.select(c("xclass").alias("x"), c("yclass").alias("y"))


def _bitmap(wanted: DataFrame) -> bytes:
    """One bit for each place that wanted has. At most 2^(BITMAP_BITS - 6) rows come to the driver."""
    cells = wanted.groupBy(F.shiftright("place", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    out[np.asarray(cells.column("cell"))] = np.asarray(cells.column("bits"))
    return out.tobytes()


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    settle, drop = scratch.settle, scratch.drop
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITMAP_BITS))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = settle(docs.mapInArrow(trimmed(_signatures(bands, rows, k)), _SIGNATURE_SCHEMA), "signed")
    known = signed.where("class is not null")

    # (bucket, class) of the classes that share a bucket with another one
    dealt = known.select("class", "bands").dropDuplicates(["class"]).select(F.explode("bands").alias("bucket"), "class")
    shared = dealt.groupBy("bucket").agg(F.min("class").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = settle(shared, "shared")  # as tables, so that both sides of a join are dealt for it alone, and a hot bucket can be split
    members = settle(dealt.join(shared, "bucket"), "members")
    first = members.groupBy("class").agg(F.max_by("hub", F.struct("size", "bucket")).alias("hub"))
    first = settle(first, "first")

    wanted = signed.select("doc_id", "class").join(first.select("class"), "class", "left_semi").select(place.alias("place"))
    bitmap = spark.sparkContext.broadcast(_bitmap(wanted))
    found = docs.select("text", place.alias("place")).mapInArrow(trimmed(_sets(k, bitmap)), _SET_SCHEMA)
    sets = settle(found.join(first.select("class"), "class", "left_semi").dropDuplicates(["class"]), "sets")

    def named(prefix: str, *columns: str) -> DataFrame:
        return sets.select(F.col("class").alias(prefix), *(F.col(c).alias(prefix + c) for c in columns))

    sketch = ("n", "level", "bits", "half")
    tested: list[DataFrame] = []

    def linked(pairs: DataFrame) -> DataFrame:
        """The links among the possible pairs (a, b)."""
        joined = pairs.join(named("b", "sh"), "b").join(named("a", "sh"), "a")
        both = F.size(F.array_intersect("ash", "bsh")).cast("long")
        links = joined.where(both * 100 >= percent * (F.size("ash") + F.size("bsh") - both))
        return settle(links.select("a", "b"), "links")

    def fresh(pairs: DataFrame) -> DataFrame:
        """The distinct (a, b) of pairs (x, y) not tested before."""
        pairs = settle(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "met")  # else each repetition is looked up
        return pairs.join(functools.reduce(DataFrame.union, tested), ["a", "b"], "left_anti") if tested else pairs

    def possible(pairs: DataFrame) -> DataFrame:
        """The distinct (a, b) of pairs (x, y) not tested before that may be links."""
        pairs = fresh(pairs).join(named("b", *sketch), "b").join(named("a", *sketch), "a")
        out = settle(pairs.where(_possible("a", "b", percent)).select("a", "b"), "pairs")
        tested.append(out)
        return out

    def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
        """comps (class, comp) after further links; a class without a row is its own component."""
        of = lambda side: comps.select(F.col("class").alias(side), F.col("comp").alias(f"{side}c"))
        raised = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b")).where("a <> b").distinct()
        over = components(raised, scratch).toDF("comp", "over")
        old = comps.join(over, "comp", "left").select("class", F.coalesce("over", "comp").alias("comp"))
        new = over.select(F.col("comp").alias("class"), F.col("over").alias("comp")).join(comps.select("class"), "class", "left_anti")
        out = settle(old.union(new), "comps")
        drop(links, comps)
        return out

    def still_open(placed: DataFrame, comps: DataFrame) -> DataFrame:
        """(bucket, class, comp, main) of the buckets with several components; main is the largest of them."""
        placed = placed.select("bucket", "class").join(comps, "class", "left").select("bucket", "class", F.coalesce("comp", "class").alias("comp"))
        sizes = placed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("size"))
        main = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
        return settle(placed.join(settle(main.drop("comps"), "main"), "bucket"), "open")

    links = linked(possible(first.where("class <> hub").select(F.col("class").alias("x"), F.col("hub").alias("y"))))
    comps = settle(components(links, scratch), "comps")
    drop(links)
    placed = members
    for turn in range(TURNS):
        before, placed = placed, still_open(placed, comps)
        drop(before)
        of_main = placed.where("comp = main")
        if turn == 0:  # what a bucket has in common makes up most of its smallest set
            of_main = of_main.join(named("class", "n").toDF("class", "n"), "class")
            pivots = of_main.groupBy("bucket").agg(F.min_by("class", F.struct("n", "class")).alias("pivot"))
        else:
            pivots = of_main.groupBy("bucket").agg(F.min_by("class", F.xxhash64("class", "bucket", F.lit(turn))).alias("pivot"))
        apart = placed.where("comp <> main").join(settle(pivots, "pivots"), "bucket")
        comps = merged(comps, linked(possible(apart.select(F.col("class").alias("x"), F.col("pivot").alias("y")))))

    before, placed = placed, still_open(placed, comps)
    drop(before)
    groups = settle(placed.select("main", "class", "comp").distinct(), "groups")
    drop(placed)
    ranked = settle(_ranked(sets, groups.select("class")), "ranked")
    # the most typical member: what a pivot has for itself makes all others differ from it
    typical = F.min_by("class", F.struct("ones", "class")).alias("pivot")
    pivots = groups.where("comp = main").join(ranked.select("class", "ones"), "class").groupBy("main").agg(typical)
    differences = settle(_differences(groups.join(settle(pivots, "pivots"), "main"), ranked, percent), "differences")
    nearby = differences.where("near AND comp <> main").select(F.col("class").alias("x"), F.col("pivot").alias("y"))
    comps = merged(comps, linked(possible(nearby.union(_sharing(differences, percent)))))

    leads = known.groupBy("class").agg(F.min("doc_id").alias("lead"))
    grouped = leads.join(comps, "class").select("class", "lead", "comp")
    names = grouped.groupBy("comp").agg(F.min("lead").alias("component_id"))
    alone = leads.join(comps, "class", "left_anti").select("class", F.col("lead").alias("component_id"))
    result = settle(grouped.join(names, "comp").select("class", "component_id").union(alone), "result")
    scratch.keep(signed, result)
    out = signed.select("doc_id", "n_shingles", "class").join(result, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


OP5_SQL = r"""
    WITH RECURSIVE
    w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
    sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
    comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
    FROM w JOIN comp USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
