import pytest
from pyspark.sql import functions as F

from quern.types import array_to_text, parse_type, text_to_array


def stored(spark, name, *values):
    """Stored form and SQLSTATE of each text."""
    t = parse_type(name)
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [(r["x"], r["s"]) for r in df.select(t.coerce(F.col("v")).alias("x"), t.violation(F.col("v")).alias("s")).collect()]


@pytest.mark.parametrize(
    ("name", "good", "bad"),
    [
        ("smallint", ["32767", "-32768", None], [("32768", "22003"), ("x", "22P02")]),
        ("tinyint", ["127"], [("128", "22003")]),
        ("tinyint unsigned", ["0", "255"], [("-1", "22003"), ("256", "22003")]),
        ("mediumint", ["8388607"], [("8388608", "22003")]),
        ("bigint unsigned", ["18446744073709551615"], [("-1", "22003"), ("18446744073709551616", "22003")]),
        ("decimal(5,2)", ["999.99", "-1.5"], [("1000", "22003"), ("q", "22P02")]),
        ("varchar(5)", ["abcde"], [("abcdef", "22001")]),
        ("tinytext", ["x" * 255], [("x" * 256, "22001")]),
        ("bit(4)", ["15", "b'1010'"], [("16", "22001")]),
        ("year", ["0", "1901", "2155", "70"], [("1900", "22003"), ("2156", "22003")]),
        ("enum('a','b')", ["a"], [("c", "22P02")]),
        ("set('a','b')", ["", "a,b"], [("a,a", "22P02"), ("c", "22P02")]),
        ("uuid", ["A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11"], [("a0eebc99", "22P02")]),
        ("boolean", ["t", "NO", "1"], [("maybe", "22P02")]),
        ("json", ['{"a": [1]}', "null"], [("{", "22P02")]),
        ("date", ["2024-02-29"], [("2023-02-29", "22007")]),
        ("datetime(3)", ["2024-01-01 10:00:00.123"], [("2024-01-01 10:00:00.1234", "22007"), ("0000-00-00 00:00:00", "22007")]),
        ("int[]", ["{1,2}", "{}"], [("{1,x}", "22P02")]),
    ],
)
def test_domains(spark, name, good, bad):
    assert [s for _, s in stored(spark, name, *good)] == [None] * len(good)
    assert [s for _, s in stored(spark, name, *(v for v, _ in bad))] == [s for _, s in bad]


def test_stored_forms(spark):
    assert stored(spark, "char(4)", "ab")[0][0] == "ab  "
    assert [x for x, _ in stored(spark, "year", "69", "70", "99")] == [2069, 1970, 1999]
    assert stored(spark, "bit(4)", "b'101'")[0][0] == 5
    assert stored(spark, "bytea", "\\x0aff")[0][0] == b"\x0a\xff"
    assert stored(spark, "binary(3)", "a")[0][0] == b"a\0\0"
    assert stored(spark, "uuid", "A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11")[0][0] == "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"


def test_array_text(spark):
    df = spark.createDataFrame([(["a", "b,c", None, "", 'q"\\', "NULL"],), ([],), (None,)], "a array<string>")
    got = [r[0] for r in df.select(array_to_text(F.col("a"))).collect()]
    assert got == ['{a,"b,c",NULL,"","q\\"\\\\","NULL"}', "{}", None]
    back = spark.createDataFrame([(x,) for x in got] + [("no array",)], "t string").select(text_to_array(F.col("t"))).collect()
    assert [r[0] for r in back] == [["a", "b,c", None, "", 'q"\\', "NULL"], [], None, None]


def test_names():
    for text, spark_name in (("character varying(3)", "string"), ("int8", "bigint"), ("float(30)", "double"), ("numeric", "decimal(38,18)"), ("timestamp with time zone", "timestamp"), ("_int4", "array<int>"), ("no_such_type", "string")):
        assert parse_type(text).spark.simpleString() == spark_name
