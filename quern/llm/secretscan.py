"""Secret scans in DataFrame functions: known forms, and a randomness test battery.

Method
  Known forms (assignments, access keys, hex runs) are found by pattern. The
  battery looks at all other runs of 20 or more key characters; in shorter ones it
  can't tell natural words from random letters. For each the encoding is inferred (hex, base32, base36 of
  either case, else base64), and three tests compare the run with a uniformly random one
  in that alphabet: chi-squared uniformity of the characters, the number of
  runs above and below the middle of the alphabet, and lag-one serial
  correlation. The smallest of the three p-values, times three, is the run's
  own. Over the whole corpus the Benjamini-Hochberg step-up rule then decides,
  in each class of lengths by itself, which runs are not random at a false
  discovery rate of `fdr`; those left are secrets. The p-values are counted in
  hundredths of a decade, so the rule needs only a table of bounded size.

Positions are code points; a match's start is the length of all pieces and
matches before it. Only DataFrame functions are used, and work grows with a text's length (running sums over
m matches take m^1.5 steps of copying, as they are made in chunks): a run of any length is read in blocks. Texts are scanned
once; what was found is kept as a table until the whole corpus is known.

Defined results: a null or empty text has no spans; very long texts and runs are scanned whole. Repeated rows give
repeated results and count as often; spans of one start are listed in the order of kinds. An empty table gives no
rows. Columns besides doc_id and text are ignored, or kept as they are by `redacted`, whatever their names; a null doc_id
stays null. A run that overlaps a known form is not listed again.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.store import read_table, settle

_KEY = "A-Za-z0-9+/_=-"
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN = rf"(?<![{_KEY}])[{_KEY}]{{20,}}"
#: In the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGNED = 12
FDR = 0.05
_BINS = 3000
_ALPHABETS = {
    16: "0123456789abcdef",
    32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    36: "0123456789abcdefghijklmnopqrstuvwxyz",
    64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
MARK = "[SECRET]"
#: Runs and redacted texts are read in blocks of so many characters.
_BLOCK_CHARS = 4096
_BLOCK = f"(?s).{{1,{_BLOCK_CHARS}}}"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _scan(values: Column, op: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each value, op over all values before it. In chunks of about the square root of their number, for each step copies its list."""

    def running(part: Column, start: Column) -> Column:
        none = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(part, none, step, lambda acc: acc["out"])

    def chunked(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.size(v) - 1, width), lambda i: F.slice(v, i + 1, width))
        starts = running(F.transform(chunks, lambda c: F.aggregate(c, zero, op)), zero)
        return F.flatten(F.zip_with(chunks, starts, running))

    return _let(values, lambda v: F.when(F.size(v) < 16, running(v, zero)).otherwise(chunked(v)))


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches, from the left without overlap: array of (start, end, value of the group)."""
    kind = "array<struct<start:int,end:int,value:string>>"
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.struct(
        F.transform(F.split(text, pattern), F.length).alias("gap"), F.transform(hits, F.length).alias("hit"),
        (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits).alias("value"),
    )

    def spans(p: Column) -> Column:
        gap = F.slice(p["gap"], F.lit(1), F.size(p["hit"]))
        before = _scan(F.zip_with(gap, p["hit"], lambda g, h: g + h), lambda a, b: a + b, F.lit(0))
        starts = F.zip_with(before, gap, lambda b, g: b + g)
        both = F.arrays_zip(starts.alias("start"), p["hit"].alias("hit"), p["value"].alias("value"))
        return F.transform(both, lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["hit"]).alias("end"), x["value"].alias("value")))

    return F.when(text.rlike(pattern), _let(parts, spans)).otherwise(F.array().cast(kind))


def _two_sided(z: Column) -> Column:
    """The probability of a normal value at least |z| from its mean (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


def _tested(runs: Column) -> Column:
    """Adds to each run its length class and the bin of its p-value."""

    def encoding(x: Column) -> Column:
        v = x["value"]
        return (
            F.when(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 16)
            .when(v.rlike("^[A-Z2-7]+=*$"), 32)
            .when(v.rlike("^(?:[0-9a-z]+|[0-9A-Z]+)$"), 36)
            .otherwise(64)
        )

    def body(x: Column) -> Column:
        v = F.when(x["k"] == 64, F.translate(F.rtrim(F.translate(x["value"], "=", " ")), "-_ ", "+/")).when(x["k"] == 32, F.translate(x["value"], "=", "")).otherwise(F.lower(x["value"]))
        return F.when(F.length(v) > 1, v).otherwise(F.lit("AA"))

    def alphabet(x: Column) -> Column:
        return F.when(x["k"] == 16, _ALPHABETS[16]).when(x["k"] == 32, _ALPHABETS[32]).when(x["k"] == 36, _ALPHABETS[36]).otherwise(_ALPHABETS[64])

    def plus(x: Column, *names: str, **new: Column) -> Column:
        return F.struct(*(x[n].alias(n) for n in names), *(c.alias(n) for n, c in new.items()))

    base = ("start", "end")
    runs = F.transform(runs, lambda x: plus(x, *base, "value", k=encoding(x)))
    runs = F.transform(runs, lambda x: plus(x, *base, "k", body=body(x), letters=alphabet(x)))

    def sums(x: Column) -> Column:
        """Sums over the places of a run, block by block: of values, squares, products with the one before, those in the upper half, and changes of half."""
        high = lambda v: (v * 2 >= x["k"]).cast("long")
        zero = F.lit(0).cast("long")

        def step(acc: Column, v: Column) -> Column:
            later = acc["last"] >= 0
            return F.struct(
                F.when(later, acc["first"]).otherwise(v).alias("first"), v.alias("last"), (acc["v"] + v).alias("v"), (acc["vv"] + v * v).alias("vv"),
                F.when(later, acc["lag"] + acc["last"] * v).otherwise(acc["lag"]).alias("lag"), (acc["n1"] + high(v)).alias("n1"),
                F.when(later & (high(v) != high(acc["last"])), acc["changes"] + 1).otherwise(acc["changes"]).alias("changes"),
            )

        values = lambda block: F.transform(F.split(block, ""), lambda y: (F.instr(x["letters"], y) - 1).cast("long"))
        none = F.struct(zero.alias("first"), (zero - 1).alias("last"), *(zero.alias(n) for n in ("v", "vv", "lag", "n1", "changes")))
        return F.aggregate(F.regexp_extract_all(x["body"], F.lit(_BLOCK), F.lit(0)), none, lambda acc, block: F.aggregate(values(block), acc, step))

    def squares(x: Column) -> Column:
        count = lambda y: F.length(x["body"]) - F.length(F.replace(x["body"], y, F.lit("")))
        return F.aggregate(F.split(x["letters"], ""), F.lit(0.0), lambda a, y: a + F.pow(count(y), F.lit(2)))

    runs = F.transform(runs, lambda x: plus(x, *base, "k", n=F.length(x["body"]), squares=squares(x), sums=sums(x)))

    def moments(x: Column) -> Column:
        t, n = x["sums"], x["n"]
        mean = t["v"] / n
        lagged = t["lag"] - mean * (2 * t["v"] - t["first"] - t["last"]) + (n - 1) * mean * mean
        return plus(x, *base, "k", "n", "squares", n1=t["n1"].cast("double"), changes=t["changes"].cast("double"), spread=t["vv"] - n * mean * mean, lagged=lagged)

    runs = F.transform(runs, moments)

    def p_value(x: Column) -> Column:
        k, n, n1 = x["k"].cast("double"), x["n"].cast("double"), x["n1"]
        chi = (k / n * x["squares"] - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        cross = 2 * n1 * (n - n1)
        variance = cross * (cross - n) / (n * n * (n - 1))
        runs_z = F.when(variance > 0, (1 + x["changes"] - 1 - cross / n) / F.sqrt(variance)).otherwise(F.lit(40.0))
        serial = F.when(x["spread"] > 1e-9, (x["lagged"] / F.when(x["spread"] > 1e-9, x["spread"]) + 1 / n) * F.sqrt(n)).otherwise(F.lit(40.0))
        uniform = _two_sided(F.greatest(chi, F.lit(0.0)))
        return F.least(F.lit(1.0), 3 * F.least(uniform, _two_sided(runs_z), _two_sided(serial)))

    bins = lambda x: F.least(F.lit(_BINS), F.floor(-100 * F.log10(F.greatest(p_value(x), F.lit(1e-40))))).cast("int")
    return F.transform(runs, lambda x: plus(x, *base, cls=F.floor(F.log2(x["n"].cast("double")) * 2).cast("int"), bin=bins(x)))


def _structured_from(counts: DataFrame, fdr: float) -> dict[int, int]:
    """For each length class, the least bin whose runs are called not random. counts: cls, bin, n."""
    out: dict[int, int] = {}
    by: dict[int, list[tuple[int, int]]] = {}
    for cls, bin_, n in counts.collect():  # at most a row for each class and bin
        by.setdefault(cls, []).append((bin_, n))
    for cls, rows in by.items():
        total, seen = sum(n for _, n in rows), 0
        for bin_, n in sorted(rows, reverse=True):
            seen += n
            if 10 ** (-bin_ / 100) <= fdr * seen / total:
                out[cls] = bin_
    return out


def _known(text: Column) -> Column:
    """Known forms: array of (start, rank of the kind, end, cls, bin), the last two 0."""
    span = lambda rank: lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(0).alias("cls"), F.lit(0).alias("bin"))
    assign = F.filter(_found(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= LEAST_ASSIGNED)
    return F.concat(F.transform(assign, span(0)), F.transform(_found(text, ACCESS), span(1)), F.transform(_found(text, HEX), span(2)))


def _apart(runs: Column, known: Column) -> Column:
    """The runs that overlap no known form: known ones that begin no later must end before, the next one must begin behind."""
    far = F.lit(2**31 - 1)

    def kept(e: Column) -> Column:
        before = _scan(F.transform(e, lambda x: F.when(x["rank"] < 3, x["end"]).otherwise(0)), _most, F.lit(0))
        after = F.reverse(_scan(F.transform(F.reverse(e), lambda x: F.when(x["rank"] < 3, x["start"]).otherwise(far)), _least, far))
        ok = lambda z: (z["e"]["rank"] == 3) & (z["before"] <= z["e"]["start"]) & (z["after"] >= z["e"]["end"])
        return F.transform(F.filter(F.arrays_zip(e.alias("e"), before.alias("before"), after.alias("after")), ok), lambda z: z["e"])

    return F.when((F.size(runs) > 0) & (F.size(known) > 0), _let(F.array_sort(F.concat(known, runs)), kept)).otherwise(runs)


def with_spans(docs: DataFrame, fdr: float = FDR, columns: list[str] | None = None) -> DataFrame:
    """(row, spans): the columns asked for (all unless given) as one struct, and the sorted array of (start, rank of the kind, end)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    span = lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("rank"), x["end"].alias("end"), x["cls"].alias("cls"), x["bin"].alias("bin"))
    found = docs.select(F.struct(*(docs[c] for c in columns or docs.columns)).alias("row"), _known(text).alias("known"), F.transform(_tested(_found(text, RUN)), span).alias("runs"))
    found = settle(found, "spans")
    counts = found.select(F.explode("runs").alias("r")).groupBy("r.cls", "r.bin").agg(F.count(F.lit(1)).alias("n"))
    limit = _structured_from(counts, fdr)
    limits = F.create_map(*(F.lit(x) for pair in limit.items() for x in pair)) if limit else F.lit(None).cast("map<int,int>")
    secret = F.filter("runs", lambda x: x["bin"] < F.coalesce(F.try_element_at(limits, x["cls"]), F.lit(_BINS + 1)))
    spans = F.array_sort(F.concat("known", _apart(secret, F.col("known"))))
    return found.select("row", F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"))).alias("spans"))


def _listed(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kinds[x["rank"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row for each row of docs."""
    found = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fdr, ["doc_id"])
    count = lambda rank: F.size(F.filter("spans", lambda x: x["rank"] == rank)).cast("long")
    base = F.filter("spans", lambda x: x["rank"] < 3)
    return found.select(
        "row.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )


def _without(text: Column, spans: Column, mark: str) -> Column:
    """text with each group of overlapping spans replaced by a mark; pieces are cut from blocks, so each is found at once."""

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        head = F.floor(a / _BLOCK_CHARS).cast("int")
        held = F.array_join(F.slice(blocks, head + 1, F.greatest(F.floor((b - 1) / _BLOCK_CHARS).cast("int") - head + 1, F.lit(0))), "")
        return F.when(b > a, F.substr(held, a - head * _BLOCK_CHARS + 1, b - a)).otherwise("")

    def cut(x: Column) -> Column:
        pairs = F.arrays_zip(x["spans"].alias("span"), _scan(F.transform(x["spans"], lambda s: s["end"]), _most, F.lit(0)).alias("at"))
        parts = F.transform(pairs, lambda p: F.when(p["span"]["start"] >= p["at"], F.concat(piece(x["blocks"], p["at"], p["span"]["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(parts, ""), piece(x["blocks"], F.array_max(F.transform(x["spans"], lambda s: s["end"])), x["n"]))

    return _let(F.struct(spans.alias("spans"), F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(0)).alias("blocks"), F.length(text).alias("n")), cut)


def redacted(docs: DataFrame, fdr: float = FDR, mark: str = MARK) -> DataFrame:
    """docs with every span of text replaced by a mark; overlapping spans by one."""
    found = with_spans(docs, fdr)
    text = F.col("row")["text"]
    clean = F.when(F.size("spans") > 0, _without(text, F.col("spans"), mark)).otherwise(text)
    return found.select(*(clean.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(read_table(spark, sf_dir, "documents"))
