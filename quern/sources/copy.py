"""Delimited files with the options of COPY and LOAD DATA; every field arrives as text."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.dialect import Token, arguments, string_value
from quern.errors import SqlError


#: Bytes of a client's stream that are handed on at a time.
_PIECE = 1 << 20


@dataclass(frozen=True)
class CopyOptions:
    """format: text (tab, `\\N`) or csv (comma, empty)."""

    format: str = "text"
    delimiter: str | None = None
    null: str | None = None
    header: bool = False
    quote: str = '"'
    escape: str | None = None

    @staticmethod
    def parse(tokens: list[Token]) -> CopyOptions:
        """The options behind COPY .. FROM: WITH (a b, ..) or the older form without brackets."""
        words = [t for t in tokens if t.word != "WITH"]
        if words and words[0].text == "(":
            items = arguments(words[1:-1])
        else:
            items, i = [], 0
            while i < len(words):
                word = words[i].word
                take = 1 + (word in ("DELIMITER", "NULL", "QUOTE", "ESCAPE", "FORMAT") and 1 + (i + 1 < len(words) and words[i + 1].word == "AS"))
                items.append([x for x in words[i : i + take] if x.word != "AS"])
                i += take
        out: dict = {}
        for item in items:
            name = item[0].word
            value = (string_value(item[1]) if item[1].kind == "string" else item[1].text) if len(item) > 1 else None
            if name in ("CSV", "TEXT"):
                out["format"] = name.lower()
            elif name == "FORMAT":
                out["format"] = value.lower()
            elif name in ("DELIMITER", "NULL", "QUOTE", "ESCAPE"):
                out[name.lower()] = value
            elif name == "HEADER":
                out["header"] = value is None or value.lower() in ("true", "on", "1")
            elif name == "ENCODING" and value.lower().replace("-", "") == "utf8":
                pass
            else:
                raise SqlError("0A000", f"COPY option {name} is not supported")
        if out.get("format", "text") not in ("text", "csv"):
            raise SqlError("0A000", f"COPY format {out['format']} is not supported")
        return CopyOptions(**out)

    @staticmethod
    def parse_load(tokens: list[Token]) -> CopyOptions:
        """FIELDS|COLUMNS TERMINATED BY c, LINES TERMINATED BY '\\n', IGNORE 1 LINES."""
        out: dict = {"delimiter": "\t"}
        for i, t in enumerate(tokens):
            if t.word in ("FIELDS", "COLUMNS") and tokens[i + 1].word == "TERMINATED":
                out["delimiter"] = _escaped(string_value(tokens[i + 3]))
                if len(out["delimiter"]) != 1:
                    raise SqlError("0A000", "fields must end with one character")
            elif t.word == "LINES" and i + 1 < len(tokens) and tokens[i + 1].word == "TERMINATED" and _escaped(string_value(tokens[i + 3])) not in ("\n", "n"):
                raise SqlError("0A000", "lines must end with a newline")
            elif t.word == "IGNORE":
                if tokens[i + 1].text != "1":
                    raise SqlError("0A000", "only one line can be ignored")
                out["header"] = True
            elif t.word in ("ENCLOSED", "OPTIONALLY", "STARTING"):
                raise SqlError("0A000", f"LOAD DATA option {t.word} is not supported")
        return CopyOptions(**out)


def _escaped(text: str) -> str:
    return {"\\t": "\t", "t": "\t", "\\n": "\n"}.get(text, text)


#: What stands for a backslash that escapes the character behind it, once a line has been read from left to right.
_ESCAPED = "\0"
_LETTERS = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", "v": "\v"}


def _unescaped(field: Column) -> Column:
    """The value of a field: letters, octal and hex numbers behind escapes; any other escaped character is itself."""

    def part(p: Column, i: Column) -> Column:
        out = p
        for letter, meant in _LETTERS.items():
            out = F.when(p.startswith(letter), F.concat(F.lit(meant), F.substr(p, F.lit(2)))).otherwise(out)
        for pattern, drop, base in ((r"^[0-7]{1,3}", 0, 8), (r"^x[0-9A-Fa-f]{1,2}", 1, 16)):
            digits = F.regexp_extract(p, pattern, 0)
            value = F.char(F.conv(F.substr(digits, F.lit(drop + 1)), base, 10).cast("int"))
            out = F.when(digits != "", F.concat(value, F.substr(p, F.length(digits) + 1))).otherwise(out)
        return F.when(i == 0, p).otherwise(out)

    return F.array_join(F.transform(F.split(field, _ESCAPED), part), "")


def _rows_of(lines: DataFrame, header: bool) -> DataFrame:
    """The lines of each file before one that is `\\.`, and behind the header, wherever the file was cut."""
    at = F.struct(F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("line"))
    placed = lines.select("value", F.input_file_name().alias("file"), at.alias("at"))
    ended = not lines.where(F.col("value") == "\\.").isEmpty()
    if not ended and not header:
        return lines
    marks = placed.groupBy("file").agg(F.min("at").alias("first"), F.min(F.when(F.col("value") == "\\.", F.col("at"))).alias("end"))
    kept = placed.join(marks, "file").where(F.col("end").isNull() | (F.col("at") < F.col("end")))
    return (kept.where(F.col("at") != F.col("first")) if header else kept).select("value")


def write_stream(spark: SparkSession, folder: str, data: str | Iterable[str]) -> str:
    """What a client sent, a text or pieces of one, as one file of a folder; it is read by parts. The folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/part")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        for piece in [data] if isinstance(data, str) else data:
            raw = piece.encode()
            for i in range(0, len(raw), _PIECE):
                out.write(bytearray(raw[i : i + _PIECE]))
    finally:
        out.close()
    return folder


def read_copy(spark: SparkSession, paths: str | list[str], width: int, options: CopyOptions) -> DataFrame:
    """Rows of `width` text columns; the query fails on a row of another width.

    Files are cut into tasks at line ends. Only csv files in which a line has an odd number of quotes, so that a
    value may go on in the next line, are read by one task each.
    """
    csv = options.format == "csv"
    names = [f"v{i}" for i in range(width)]
    reader = spark.read.schema(", ".join(f"{n} string" for n in names)).option("header", options.header).option("mode", "FAILFAST").option("enforceSchema", True)
    if csv:
        quotes = F.length("value") - F.length(F.replace("value", F.lit(options.quote), F.lit("")))
        across = bool(options.quote) and not spark.read.text(paths).where(quotes % 2 == 1).isEmpty()
        reader = reader.option("sep", options.delimiter or ",").option("quote", options.quote).option("escape", options.escape or options.quote).option("nullValue", options.null or "").option("emptyValue", "").option("multiLine", across)
        return reader.csv(paths)
    once = lambda text: re.sub(r"(?s)\\(.)", _ESCAPED + r"\1", text)
    null = once("\\N" if options.null is None else options.null)
    lines = _rows_of(spark.read.text(paths), options.header).select(F.regexp_replace("value", r"(?s)\\(.)", _ESCAPED + "$1").alias("value"))
    fields = F.split("value", f"(?<!{_ESCAPED})" + re.escape(options.delimiter or "\t"))
    wrong = F.raise_error(F.concat(F.lit("22P04: value out of the domain of a row: "), "value")).cast("array<string>")
    rows = lines.select(F.when(F.size(fields) == width, fields).otherwise(wrong).alias("f"))
    return rows.select(*(F.when(F.col("f")[i] != null, _unescaped(F.col("f")[i])).alias(n) for i, n in enumerate(names)))
