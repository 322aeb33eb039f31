"""Scans: key lookups, ranges, projections and limits, all left to the Parquet reader's pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans.base import Family, table

_family = Family()
QUERIES, ORACLE_SQL = _family.queries, _family.oracle
_ORDER = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@_family.add("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 1000")
def scan_point_lookup(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderkey") == 1000).select(*_ORDER)


@_family.add("SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey IN (7, 3, 3, 99999999, 42)")
def scan_pk_in(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderkey").isin(7, 3, 3, 99999999, 42, None)).select(*_ORDER)


@_family.add("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey BETWEEN 500 AND 900")
def scan_pk_range(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderkey").between(500, 900)).select(*_ORDER)


@_family.add("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey > 100 AND o_orderkey < 140 AND o_totalprice > 1000")
def scan_pk_range_open(spark, d):
    key = F.col("o_orderkey")
    return table(spark, d, "orders").where((key > 100) & (key < 140) & (F.col("o_totalprice") > 1000)).select(*_ORDER)


@_family.add("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 37 AND o_totalprice > 500")
def scan_index_eq(spark, d):
    return table(spark, d, "orders").where((F.col("o_custkey") == 37) & (F.col("o_totalprice") > 500)).select("o_orderkey", "o_totalprice")


@_family.add("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 10 AND o_custkey < 13")
def scan_index_range(spark, d):
    return table(spark, d, "orders").where((F.col("o_custkey") >= 10) & (F.col("o_custkey") < 13)).select("o_orderkey", "o_custkey")


@_family.add("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R' AND l_discount <> 0.05")
def scan_full_filter(spark, d):
    rows = table(spark, d, "lineitem").where((F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R") & (F.col("l_discount") != 0.05))
    return rows.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@_family.add("SELECT p_partkey AS id, p_name AS name, p_size * 2 + 1 AS twice FROM part")
def scan_projection(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") * 2 + 1).alias("twice"))


@_family.add("SELECT o_orderkey FROM orders WHERE o_orderkey <= 1000")
def scan_key_only(spark, d):
    return table(spark, d, "orders").select("o_orderkey").where(F.col("o_orderkey") <= 1000)


@_family.add("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 25 OFFSET 5")
def scan_limit_ordered(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderstatus") == "F").orderBy("o_orderkey").offset(5).limit(25).select("o_orderkey", "o_totalprice")


@_family.add("SELECT count(*) AS n FROM lineitem")
def scan_count_star(spark, d):
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@_family.add("SELECT count(*) AS n FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 5000")
def scan_count_range(spark, d):
    return table(spark, d, "orders").where((F.col("o_orderkey") >= 1000) & (F.col("o_orderkey") < 5000)).agg(F.count(F.lit(1)).alias("n"))


@_family.add("SELECT l_shipdate, sum(l_quantity) AS q FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31' AND NOT (l_linenumber < 3 OR l_linenumber > 5) GROUP BY l_shipdate")
def scan_zone_map(spark, d):
    at, line = F.col("l_shipdate"), F.col("l_linenumber")
    ship = at.between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1995-03-31").cast("timestamp_ntz"))
    return table(spark, d, "lineitem").where(ship & ~((line < 3) | (line > 5))).groupBy("l_shipdate").agg(F.sum("l_quantity").alias("q"))


@_family.add("SELECT * FROM (VALUES (1, 'a', 10), (2, 'b', NULL), (3, NULL, 30)) AS v(id, name, amount)")
def scan_values(spark, d):
    return spark.createDataFrame([(1, "a", 10), (2, "b", None), (3, None, 30)], "id int, name string, amount int")
