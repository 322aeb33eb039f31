"""Logical SQL types: what they are in Spark, how values are coerced, and which are refused.

A type gives two Column rules. `coerce` turns any value (mostly text) into the
stored form; `violation` is an SQLSTATE for values that may not be stored and
NULL for those that may. Neither raises by itself, so whole tables can be
checked in one pass; `checked` makes a column that raises on the first bad value.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import SqlError

_SIGNED = {"tinyint": 8, "smallint": 16, "int2": 16, "smallserial": 16, "mediumint": 24, "int": 32, "integer": 32, "int4": 32, "serial": 32, "bigint": 64, "int8": 64, "bigserial": 64}
_TEXT_BYTES = {"tinytext": 255, "text": None, "string": None, "mediumtext": 16_777_215, "longtext": None, "tinyblob": 255, "blob": 65_535, "mediumblob": 16_777_215, "longblob": None, "bytea": None}
_UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
_GEOMETRY = frozenset("geometry point linestring polygon multipoint multilinestring multipolygon geometrycollection".split())
#: Texts that mean true and false.
TRUE_WORDS = ("t", "true", "y", "yes", "on", "1")
FALSE_WORDS = ("f", "false", "n", "no", "off", "0")


@dataclass(frozen=True)
class LogicalType:
    name: str
    spark: T.DataType
    size: int | None = None
    scale: int | None = None
    unsigned: bool = False
    labels: tuple[str, ...] = field(default=())
    element: LogicalType | None = None

    @property
    def serial(self) -> bool:
        return self.name in ("serial", "bigserial", "smallserial")

    def sql(self) -> str:
        """The name as it would be declared."""
        if self.element:
            return self.element.sql() + "[]"
        if self.labels:
            return f"{self.name}({', '.join(repr(x) for x in self.labels)})"
        inside = "" if self.size is None else f"({self.size})" if self.scale is None else f"({self.size},{self.scale})"
        return self.name + inside + (" unsigned" if self.unsigned else "")

    def coerce(self, x: Column) -> Column:
        text = x.cast("string")
        if self.element:
            return F.transform(text_to_array(text), self.element.coerce)
        match self.name:
            case n if n in _SIGNED and not isinstance(self.spark, T.DecimalType):
                return F.trim(text).try_cast("decimal(38,10)").cast("decimal(38,0)").try_cast(self.spark)
            case "bit":
                return F.when(text.rlike("^[bB]'[01]+'$"), F.conv(F.regexp_extract(text, "([01]+)", 1), 2, 10).try_cast("long")).otherwise(text.try_cast("long"))
            case "year":
                y = text.try_cast("int")
                return F.when((y >= 0) & (y <= 69) & (F.length(text) <= 2), y + 2000).when((y >= 70) & (y <= 99), y + 1900).otherwise(y)
            case "char":
                return F.rpad(text, F.greatest(F.lit(self.size), F.length(text)), F.lit(" "))
            case "boolean":
                word = F.lower(F.trim(text))
                return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
            case "uuid":
                return F.lower(text)
            case n if isinstance(self.spark, T.BinaryType):
                raw = F.when(text.startswith("\\x"), F.unhex(F.substr(text, F.lit(3)))).otherwise(F.to_binary(text, F.lit("utf-8")))
                return F.rpad(raw, F.greatest(F.lit(self.size), F.octet_length(raw)), F.unhex(F.lit("00"))) if n == "binary" else raw
            case _ if isinstance(self.spark, T.StringType):
                return text
            case _:
                return text.try_cast(self.spark)

    def violation(self, x: Column) -> Column:
        """x is the raw value; the SQLSTATE that storing it would raise, or NULL."""
        text, value = x.cast("string"), self.coerce(x)
        none = F.lit(None).cast("string")
        state = F.when(x.isNotNull() & value.isNull(), self._unreadable(text))
        if self.name in _SIGNED and (self.unsigned or self.name == "mediumint" or self.name == "tinyint"):
            low, high = (F.lit(Decimal(x)) for x in self.range())
            wide = F.trim(text).try_cast("decimal(38,0)")
            state = F.coalesce(state, F.when((wide < low) | (wide > high), "22003"))
        elif self.name == "bit":
            state = F.coalesce(state, F.when((value < 0) | (value >= 2 ** min(62, self.size or 1)), "22001"))
        elif self.name == "year":
            state = F.coalesce(state, F.when((value != 0) & ((value < 1901) | (value > 2155)), "22003"))
        elif self.name in ("char", "varchar") and self.size is not None:
            state = F.when(F.length(text) > self.size, "22001")
        elif self.name in ("binary", "varbinary") and self.size is not None:
            state = F.coalesce(state, F.when(F.octet_length(value) > self.size, "22001"))
        elif _TEXT_BYTES.get(self.name):
            state = F.when(F.octet_length(text) > _TEXT_BYTES[self.name], "22001")
        elif self.name == "decimal" and self.size is not None:
            plain = F.trim(text).try_cast("decimal(38,18)")
            state = F.coalesce(state, F.when(F.abs(plain) >= 10 ** (self.size - (self.scale or 0)), "22003"))
        elif self.name == "enum":
            state = F.when(~text.isin(*self.labels), "22P02")
        elif self.name == "set":
            parts = F.split(text, ",")
            wrong = F.exists(parts, lambda p: ~p.isin(*self.labels)) | (F.size(F.array_distinct(parts)) != F.size(parts))
            state = F.when((text != "") & wrong, "22P02")
        elif self.name == "uuid":
            state = F.when(~text.rlike(_UUID), "22P02")
        elif self.name in ("json", "jsonb"):
            state = F.when(F.try_parse_json(text).isNull() & x.isNotNull(), "22P02")
        elif self.name in ("timestamp", "datetime") and self.size is not None:
            state = F.coalesce(state, F.when(F.length(F.regexp_extract(text, r"\.(\d+)", 1)) > self.size, "22007"))
        elif self.element:
            state = F.coalesce(state, F.get(F.filter(F.transform(text_to_array(text), self.element.violation), lambda s: s.isNotNull()), F.lit(0)))
        return F.when(x.isNotNull(), F.coalesce(state, none))

    def _unreadable(self, text: Column) -> Column:
        """Why a value has no stored form: out of range, or not of the type at all."""
        if self.name in _SIGNED:
            return F.when(F.trim(text).rlike(r"^[+-]?\d+(\.\d*)?$"), "22003").otherwise("22P02")
        if isinstance(self.spark, T.DecimalType):
            return F.when(F.trim(text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "22003").otherwise("22P02")
        if isinstance(self.spark, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.lit("22007")
        return F.lit("22P02")

    def range(self) -> tuple[int, int]:
        bits = _SIGNED[self.name]
        return (0, 2**bits - 1) if self.unsigned else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)

    def checked(self, x: Column, name: str) -> Column:
        """The stored form; the query fails on a value that may not be stored."""
        bad = self.violation(x)
        stop = F.raise_error(F.concat(bad, F.lit(f": value out of the domain of column {name} ({self.sql()})")))
        return F.when(bad.isNotNull(), stop.cast(self.spark)).otherwise(self.coerce(x))


def parse_type(text: str) -> LogicalType:
    """A declared type name, in either dialect."""
    t = re.sub(r"\s+", " ", text.strip())
    low = t.lower()
    if m := re.fullmatch(r"(.+?)\s*\[\s*\d*\s*\]", low) or re.fullmatch(r"array\s*<(.+)>", low) or re.fullmatch(r"_(\w+)", low) or re.fullmatch(r"(.+) array", low):
        inner = parse_type(m[1])
        return LogicalType("array", T.ArrayType(inner.spark), element=inner)
    m = re.fullmatch(r"(?i)([a-z_][a-z0-9_]*(?: precision| varying)?)\s*(?:\((.*?)\))?\s*(.*)", t)
    if not m:
        return LogicalType("text", T.StringType())
    name, args, tail = m[1].lower(), m[2], m[3].lower()
    if name in ("enum", "set"):
        labels = tuple(x.replace("''", "'") for x in re.findall(r"'((?:[^']|'')*)'", args or ""))
        return LogicalType(name, T.StringType(), labels=labels)
    numbers = [int(x) for x in re.findall(r"\d+", args or "")]
    size = numbers[0] if numbers else None
    if name in _SIGNED:
        unsigned = "unsigned" in tail
        bits = _SIGNED[name] + unsigned
        spark = T.ShortType() if bits <= 16 else T.IntegerType() if bits <= 32 else T.LongType() if bits <= 64 else T.DecimalType(20, 0)
        return LogicalType(name, spark, unsigned=unsigned)
    if name in ("real", "float4") or name == "float" and (size is None or size <= 24):
        return LogicalType("real", T.FloatType())
    if name in ("double", "double precision", "float8", "float"):
        return LogicalType("double", T.DoubleType())
    if name in ("decimal", "numeric", "dec", "fixed"):
        scale = numbers[1] if len(numbers) > 1 else 0
        return LogicalType("decimal", T.DecimalType(size, scale) if size else T.DecimalType(38, 18), size, scale if size else None)
    if name in ("varchar", "character varying"):
        return LogicalType("varchar", T.StringType(), size)
    if name in ("char", "character", "bpchar"):
        return LogicalType("char", T.StringType(), size or 1)
    if name in ("binary", "varbinary") or name in _TEXT_BYTES and (name.endswith("blob") or name == "bytea"):
        return LogicalType(name, T.BinaryType(), size or 1 if name == "binary" else size)
    if name in _TEXT_BYTES:
        return LogicalType("text" if name == "string" else name, T.StringType())
    if name in ("bool", "boolean"):
        return LogicalType("boolean", T.BooleanType())
    if name == "bit":
        return LogicalType("bit", T.LongType(), size or 1)
    if name == "year":
        return LogicalType("year", T.IntegerType())
    if name == "date":
        return LogicalType("date", T.DateType())
    if name == "timestamptz" or name == "timestamp" and tail == "with time zone":
        return LogicalType("timestamptz", T.TimestampType())
    if name in ("timestamp", "datetime"):
        return LogicalType(name, T.TimestampNTZType(), size)
    if name in ("time", "timetz", "interval", "uuid", "json", "jsonb"):
        return LogicalType(name, T.StringType(), size if name == "time" else None)
    if name in _GEOMETRY:
        return LogicalType("geometry", T.StringType())
    return LogicalType("text", T.StringType())


def from_spark(t: T.DataType) -> LogicalType:
    """The logical type of a query's column, for CREATE TABLE AS."""
    names = {"byte": "smallint", "short": "smallint", "integer": "int", "long": "bigint", "float": "real", "double": "double", "boolean": "boolean", "binary": "bytea", "date": "date", "timestamp": "timestamptz", "timestamp_ntz": "timestamp"}
    if isinstance(t, T.ArrayType):
        inner = from_spark(t.elementType)
        return LogicalType("array", t, element=inner)
    if isinstance(t, T.DecimalType):
        return LogicalType("decimal", t, t.precision, t.scale)
    return LogicalType(names.get(t.typeName(), "text"), t if t.typeName() in names else T.StringType())


def array_to_text(x: Column) -> Column:
    """`{a,"b,c",NULL}`: quoted where an element is empty, has a comma, brace, quote, backslash or space, or reads NULL."""

    def element(e: Column) -> Column:
        text = e.cast("string")
        quoted = F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        return F.when(text.isNull(), "NULL").when((text == "") | text.rlike(r'[,{}"\\\s]') | (F.upper(text) == "NULL"), quoted).otherwise(text)

    return F.concat(F.lit("{"), F.array_join(F.transform(x, element), ","), F.lit("}"))


def text_to_array(x: Column) -> Column:
    """The elements of a one-level `{...}` text; NULL if it isn't one."""
    inside = F.regexp_extract(x, r"(?s)^\s*\{(.*)\}\s*$", 1)
    parts = F.regexp_extract_all(inside, F.lit(r'(?s)\s*("(?:[^"\\]|\\.)*"|[^,]*)\s*(?:,|$)'), F.lit(1))

    def element(e: Column) -> Column:
        quoted = F.regexp_replace(F.substr(e, F.lit(2), F.length(e) - 2), r"\\(.)", "$1")
        return F.when(e.startswith('"'), quoted).when(F.upper(F.trim(e)) != "NULL", F.trim(e))

    # the pattern also matches the empty rest after the last element
    whole = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    found = F.when(F.trim(inside) == "", F.array().cast("array<string>")).otherwise(F.transform(whole, element))
    return F.when(x.rlike(r"(?s)^\s*\{.*\}\s*$"), found)


def check_value(text: str, value, spark) -> None:
    """Raise SqlError if one Python value may not be stored in a declared type."""
    row = spark.range(1).select(parse_type(text).violation(F.lit(value)).alias("s")).first()
    if row["s"]:
        raise SqlError(row["s"], f"{value!r} is not a valid {text}")
