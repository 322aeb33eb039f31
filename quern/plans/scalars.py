"""Scalar functions: strings, dates, arithmetic, JSON, arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern import functions as Q
from quern.plans.base import Family, table

_family = Family()
QUERIES, ORACLE_SQL = _family.queries, _family.oracle
_c = F.col


@_family.add("SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, length(c_name) AS n FROM customer")
def fn_lower_upper_length(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.lower("c_name").alias("lo"), F.upper("c_mktsegment").alias("up"), F.length("c_name").cast("long").alias("n"))


@_family.add("SELECT p_partkey, substring(p_name, 1, 4) AS a, substring(p_name, 3, 5) AS b, trim(concat('  ', p_brand, ' ')) AS t, trim(p_brand, 'B') AS x FROM part")
def fn_substring_trim(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", Q.substring_from(_c("p_name"), -2, 4).alias("a"), Q.substring_from(_c("p_name"), 3, 5).alias("b"), F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("t"), F.expr("trim(BOTH 'B' FROM p_brand)").alias("x")
    )


@_family.add("SELECT p_partkey, replace(p_type, 'E', '-e-') AS r FROM part")
def fn_replace(spark, d):
    return table(spark, d, "part").select("p_partkey", F.replace("p_type", F.lit("E"), F.lit("-e-")).alias("r"))


@_family.add("SELECT c_custkey, concat(c_name, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE '-' END, c_nationkey) AS r FROM customer")
def fn_concat_nullskip(spark, d):
    return table(spark, d, "customer").select("c_custkey", Q.concat_skip("c_name", F.when(_c("c_custkey") % 2 != 0, "-"), "c_nationkey").alias("r"))


@_family.add("SELECT c_custkey, concat_ws('/', c_name, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'odd' END, c_mktsegment) AS r FROM customer")
def fn_concat_ws(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.concat_ws("/", "c_name", F.when(_c("c_custkey") % 2 != 0, "odd"), "c_mktsegment").alias("r"))


@_family.add("SELECT p_partkey, array_to_string(string_split(p_type, ' ')[:2], ' ') AS a, array_to_string(string_split(p_type, ' ')[-1:], ' ') AS b FROM part")
def fn_substring_index(spark, d):
    return table(spark, d, "part").select("p_partkey", F.substring_index("p_type", " ", 2).alias("a"), F.substring_index("p_type", " ", -1).alias("b"))


@_family.add("SELECT p_partkey, instr(p_name, 'e') AS a, CASE WHEN instr(substring(p_name, 4), 'e') = 0 THEN 0 ELSE instr(substring(p_name, 4), 'e') + 3 END AS b FROM part")
def fn_locate_instr(spark, d):
    return table(spark, d, "part").select("p_partkey", F.instr("p_name", "e").cast("long").alias("a"), F.locate("e", "p_name", 4).cast("long").alias("b"))


@_family.add("""
    SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS f,
           CASE c_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' ELSE NULL END AS e FROM customer
""")
def fn_field_elt(spark, d):
    return table(spark, d, "customer").select("c_custkey", Q.field(_c("c_mktsegment"), "BUILDING", "MACHINERY").alias("f"), Q.elt(_c("c_nationkey"), "one", "two", "three").alias("e"))


@_family.add("SELECT c_custkey, coalesce(list_position(['AUTOMOBILE', 'BUILDING'], c_mktsegment), 0) AS p FROM customer")
def fn_find_in_set(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.find_in_set("c_mktsegment", F.lit("AUTOMOBILE,BUILDING")).cast("long").alias("p"))


@_family.add("SELECT p_partkey, printf('%.3f', p_retailprice * 1.0) AS f FROM part")
def fn_format(spark, d):
    return table(spark, d, "part").select("p_partkey", Q.format_fixed(_c("p_retailprice"), 3).alias("f"))


@_family.add("SELECT p_partkey, replace(p_name, 'a', 'o') AS r, regexp_matches(p_name, '^.*e') AS m FROM part")
def fn_regexp_replace(spark, d):
    return table(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit("a"), F.lit("o")).alias("r"), F.regexp_like("p_name", F.lit("^.*e")).alias("m"))


@_family.add("SELECT p_partkey, left(p_name, 3) AS a, right(p_name, 2) AS b, reverse(p_name) AS c, lpad(p_name, 20, '*') AS d, repeat('x', p_size) AS e, md5(p_name) AS f, split_part(p_type, ' ', 2) AS g FROM part")
def fn_library_strings(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", "left(p_name, 3) AS a", "right(p_name, 2) AS b", "reverse(p_name) AS c", "lpad(p_name, 20, '*') AS d", "repeat('x', p_size) AS e", "md5(p_name) AS f", "split_part(p_type, ' ', 2) AS g")


@_family.add("SELECT event_id, date_trunc('year', ts) AS y, date_trunc('month', ts) AS m, date_trunc('hour', ts) AS h FROM events")
def fn_date_trunc(spark, d):
    t = lambda u: F.date_trunc(u, "ts").cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", t("year").alias("y"), t("month").alias("m"), t("hour").alias("h"))


@_family.add("SELECT event_id, extract(year FROM ts) AS y, extract(month FROM ts) AS m, extract(day FROM ts) AS dd, extract(hour FROM ts) AS h, extract(minute FROM ts) AS mi, extract(second FROM ts) AS s FROM events")
def fn_extract(spark, d):
    return table(spark, d, "events").selectExpr("event_id", *(f"CAST(extract({u} FROM ts) AS BIGINT) AS {n}" for u, n in (("year", "y"), ("month", "m"), ("day", "dd"), ("hour", "h"), ("minute", "mi"), ("second", "s"))))


@_family.add("SELECT o_orderkey, o_orderdate + INTERVAL 1 MONTH AS m, o_orderdate - INTERVAL 10 DAY AS dd, o_orderdate + INTERVAL 14 DAY AS w FROM orders")
def fn_date_add_sub(spark, d):
    at = _c("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", Q.date_add_interval(at, 1, "month").alias("m"), Q.date_add_interval(at, -10, "day").alias("dd"), Q.date_add_interval(at, 2, "week").alias("w"))


@_family.add("SELECT o_orderkey, o_orderdate + INTERVAL 3 HOUR AS h, o_orderdate + INTERVAL 2 YEAR AS y FROM orders")
def fn_timestampadd(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.expr("timestampadd(HOUR, 3, o_orderdate)").alias("h"), Q.date_add_interval(_c("o_orderdate"), 2, "year").alias("y"))


@_family.add("SELECT l_orderkey, l_linenumber, datediff('month', o_orderdate, l_shipdate) AS m, datediff('day', o_orderdate, l_shipdate) AS dd, datediff('day', o_orderdate, l_shipdate) // 7 AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate")
def fn_timestampdiff(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).where("l_shipdate >= o_orderdate")
    a, b = _c("o_orderdate"), _c("l_shipdate")
    return rows.select("l_orderkey", "l_linenumber", Q.timestampdiff("month", a, b).alias("m"), Q.timestampdiff("day", a, b).alias("dd"), Q.timestampdiff("week", a, b).alias("w"))


@_family.add("SELECT event_id, strftime(ts, '%Y/%m/%d %H-%M-%S') AS f FROM events")
def fn_date_format(spark, d):
    return table(spark, d, "events").select("event_id", Q.date_format_mysql(_c("ts"), "%Y/%m/%d %H-%i-%s").alias("f"))


@_family.add("SELECT event_id, date_trunc('second', ts) AS back FROM events")
def fn_str_to_date(spark, d):
    text = Q.date_format_mysql(_c("ts"), "%d.%m.%Y %H:%i:%s")
    return table(spark, d, "events").select("event_id", Q.str_to_date(text, "%d.%m.%Y %H:%i:%s").alias("back"))


@_family.add("SELECT event_id, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) * 86400 AS u FROM events")
def fn_unix_timestamp(spark, d):
    return table(spark, d, "events").select("event_id", Q.unix_timestamp_days(_c("ts")).alias("u"))


@_family.add("SELECT event_id, strftime(make_timestamp(greatest((event_id - 50) * 86399, 0) * 1000000), '%Y-%m-%d %H:%M:%S') AS t FROM events")
def fn_from_unixtime(spark, d):
    return table(spark, d, "events").select("event_id", Q.from_unixtime_utc((_c("event_id") - 50) * 86399).alias("t"))


@_family.add("SELECT o_orderkey, last_day(o_orderdate) AS l FROM orders")
def fn_last_day(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.last_day("o_orderdate").alias("l"))


@_family.add("SELECT o_orderkey, (dayofyear(o_orderdate) - 1) // 7 AS w FROM orders")
def fn_week(spark, d):
    return table(spark, d, "orders").select("o_orderkey", Q.week_of_year(_c("o_orderdate")).cast("long").alias("w"))


@_family.add("SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal) AS r, ceil(c_acctbal) AS c, floor(c_acctbal) AS f FROM customer")
def fn_abs_round_ceil_floor(spark, d):
    bal = _c("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.abs(bal).alias("a"), Q.round_double(bal).alias("r"), F.ceil(bal).cast("double").alias("c"), F.floor(bal).cast("double").alias("f"))


@_family.add("SELECT o_orderkey, CAST(trunc(o_orderkey / 7) AS BIGINT) AS q, CAST(trunc((0 - o_custkey) / 4) AS BIGINT) AS z, CAST(trunc(o_custkey / (-4)) AS BIGINT) AS y FROM orders")
def fn_int_division(spark, d):
    key = _c("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", Q.int_div(_c("o_orderkey"), F.lit(7)).alias("q"), Q.int_div(-key, F.lit(4)).alias("z"), Q.int_div(key, F.lit(-4)).alias("y"))


@_family.add("SELECT o_orderkey, (0 - o_orderkey) % 7 AS m, o_orderkey % (-5) AS k FROM orders")
def fn_mod_div(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (-_c("o_orderkey") % 7).alias("m"), (_c("o_orderkey") % F.lit(-5)).alias("k"))


@_family.add("SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS b, xor(o_orderkey, 255) AS c, ~o_orderkey AS n FROM orders")
def fn_bitops(spark, d):
    k = _c("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", k.bitwiseAND(12).alias("a"), k.bitwiseOR(3).alias("b"), k.bitwiseXOR(255).alias("c"), F.bitwise_not(k).alias("n"))


@_family.add("SELECT p_partkey, coalesce(TRY_CAST(regexp_extract(concat(p_size, 'abc'), '^[0-9]+') AS DOUBLE), CAST(0 AS DOUBLE)) AS n, CAST(0 AS DOUBLE) AS z FROM part")
def fn_text_to_number(spark, d):
    return table(spark, d, "part").select("p_partkey", Q.text_to_number(F.concat(_c("p_size").cast("string"), F.lit("abc"))).alias("n"), Q.text_to_number(_c("p_name")).alias("z"))


@_family.add("SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS a, nullif(c_mktsegment, 'BUILDING') AS b FROM customer")
def fn_coalesce_nullif(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.coalesce(F.nullif("c_nationkey", F.lit(3)), F.lit(-1)).alias("a"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("b"))


@_family.add("SELECT c_custkey, greatest(c_nationkey, 7, NULL) AS g, least(c_nationkey, 7, NULL) AS l FROM customer")
def fn_greatest_least(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey", "greatest(c_nationkey, 7, NULL) AS g", "least(c_nationkey, 7, NULL) AS l")


@_family.add("SELECT o_orderkey FROM orders WHERE (o_orderkey % 3) <> 0 AND NOT (o_custkey % 2 <> 0)")
def fn_truthiness(spark, d):
    return table(spark, d, "orders").where(Q.truthy(_c("o_orderkey") % 3) & ~Q.truthy(_c("o_custkey") % 2)).select("o_orderkey")


@_family.add("SELECT p_partkey, round(sqrt(p_retailprice), 6) AS s, round(power(p_size, 2), 2) AS p, round(ln(p_retailprice), 6) AS l, round(sin(p_size), 6) AS t, sign(p_size - 20) AS g FROM part")
def fn_library_maths(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", "round(sqrt(p_retailprice), 6) AS s", "round(power(p_size, 2), 2) AS p", "round(ln(p_retailprice), 6) AS l", "round(sin(p_size), 6) AS t", "CAST(sign(p_size - 20) AS INT) AS g")


@_family.add("SELECT event_id, json_extract(props, '$.k') ->> '$' AS k FROM events")
def json_arrow(spark, d):
    return table(spark, d, "events").select("event_id", Q.json_arrow(_c("props"), "k").alias("k"))


@_family.add("SELECT event_id, props ->> '$.k' AS k, CAST(props ->> '$.k' AS INT) + 1 AS k1 FROM events")
def json_arrow_text(spark, d):
    k = Q.json_arrow_text(_c("props"), "k")
    return table(spark, d, "events").select("event_id", k.alias("k"), (k.cast("int") + 1).alias("k1"))


@_family.add("SELECT event_id, concat('[', props ->> '$.k', ',', props ->> '$.k', ']') AS both FROM events")
def json_extract_multi(spark, d):
    return table(spark, d, "events").select("event_id", Q.json_extract(_c("props"), "$.k", "$.missing", "$.k").alias("both"))


@_family.add("SELECT event_id FROM events WHERE CAST(props ->> '$.k' AS INT) = 7")
def json_contains(spark, d):
    return table(spark, d, "events").where(Q.json_contains(_c("props"), F.lit('{"k": 7}'))).select("event_id")


@_family.add("SELECT event_id, list_contains(json_keys(props), 'k') AS a, list_contains(json_keys(props), 'z') AS b FROM events")
def json_has_key(spark, d):
    return table(spark, d, "events").select("event_id", Q.json_has_key(_c("props"), "k").alias("a"), Q.json_has_key(_c("props"), "z").alias("b"))


@_family.add("""
    SELECT event_id, concat('{"k":', props ->> '$.k', ',"n":', event_id, '}') AS s, concat('{"k":"', event_type, '"}') AS r, '{}' AS x FROM events
""")
def json_set_replace_remove(spark, d):
    p = _c("props")
    return table(spark, d, "events").select("event_id", Q.json_set(p, "$.n", _c("event_id")).alias("s"), Q.json_replace(p, "$.k", _c("event_type")).alias("r"), Q.json_remove(p, "$.k").alias("x"))


@_family.add("""
    SELECT event_id, concat('{"id":', event_id, ',"t":"', event_type, '"}') AS o, concat('[', event_id, ',"', event_type, '",null]') AS a FROM events
""")
def json_object_array(spark, d):
    return table(spark, d, "events").select("event_id", Q.json_object("id", _c("event_id"), "t", _c("event_type")).alias("o"), Q.json_array(_c("event_id"), _c("event_type"), F.lit(None).cast("string")).alias("a"))


@_family.add("SELECT event_id, event_type AS u FROM events")
def json_unquote(spark, d):
    return table(spark, d, "events").select("event_id", Q.json_unquote(F.concat(F.lit('"'), "event_type", F.lit('"'))).alias("u"))


@_family.add("SELECT vec_id, label, list_contains([1, 2, 4], label) AS i, len(embedding) AS n, embedding[1] AS f FROM embeddings")
def arr_literal(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.array_contains(F.array(*map(F.lit, (1, 2, 4))), _c("label")).alias("i"), F.size("embedding").cast("long").alias("n"), _c("embedding")[0].alias("f"))


@_family.add("SELECT n_regionkey, concat('{', array_to_string(list_sort(array_agg(n_name)), ','), '}') AS t FROM nation GROUP BY n_regionkey")
def arr_text_io(spark, d):
    from quern.types import array_to_text

    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("a")).select("n_regionkey", array_to_text(_c("a")).alias("t"))
