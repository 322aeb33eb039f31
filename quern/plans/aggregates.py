"""Aggregation: scalar and grouped, HAVING, distinct, NULL rules, grouping sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans.base import Family, table

_family = Family()
QUERIES, ORACLE_SQL = _family.queries, _family.oracle
_one = F.lit


def _n():
    return F.count(F.lit(1)).alias("n")


def _money(name="o_totalprice"):
    return F.round(F.sum(name), 2)


@_family.add("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey BETWEEN 100 AND 40000 GROUP BY o_orderstatus")
def agg_range_group(spark, d):
    orders = table(spark, d, "orders").where(F.col("o_orderkey").between(100, 40000))
    return orders.groupBy("o_orderstatus").agg(_n(), _money().alias("total"))


@_family.add("SELECT count(*) AS n, max(o_totalprice) AS most FROM orders")
def agg_count_max(spark, d):
    return table(spark, d, "orders").agg(_n(), F.max("o_totalprice").alias("most"))


@_family.add("SELECT round(sum(o_totalprice), 2) AS total FROM orders")
def agg_sum(spark, d):
    return table(spark, d, "orders").agg(_money().alias("total"))


@_family.add("SELECT count(*) AS n, count(o_totalprice) AS k, CAST(sum(o_custkey) AS BIGINT) AS keys, round(avg(o_totalprice), 4) AS mean, min(o_orderdate) AS first FROM orders")
def agg_count_sum_avg(spark, d):
    return table(spark, d, "orders").agg(_n(), F.count("o_totalprice").alias("k"), F.sum("o_custkey").alias("keys"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.min("o_orderdate").alias("first"))


@_family.add("SELECT count(*) AS n FROM orders WHERE o_orderkey >= 1000 AND o_orderkey <= 2000")
def agg_range_count(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderkey").between(1000, 2000)).agg(_n())


@_family.add("SELECT round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS most FROM orders WHERE o_orderkey BETWEEN 1000 AND 9000")
def agg_range_sum_max(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderkey").between(1000, 9000)).agg(_money().alias("total"), F.max("o_totalprice").alias("most"))


@_family.add("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def agg_filter_count(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderstatus") == "F").agg(_n())


@_family.add("SELECT round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F'")
def agg_filter_sum(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderstatus") == "F").agg(_money().alias("total"))


@_family.add("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def agg_group(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(_n())


@_family.add("SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def agg_group_sum(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(_money().alias("total"))


@_family.add("""
    SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
    FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def agg_multi_group(spark, d):
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), revenue.alias("revenue"), _n())


@_family.add("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def agg_having(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(_n()).where("n > 12")


@_family.add("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 5 ORDER BY n DESC, o_custkey LIMIT 20")
def agg_having_order_limit(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(_n()).where("n >= 5").orderBy(F.desc("n"), "o_custkey").limit(20)


@_family.add("SELECT count(DISTINCT o_custkey) AS n FROM orders")
def agg_count_distinct(spark, d):
    return table(spark, d, "orders").agg(F.countDistinct("o_custkey").alias("n"))


@_family.add("SELECT o_orderpriority, count(DISTINCT o_custkey) AS who, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderpriority")
def agg_mixed_distinct(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("who"), _n(), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@_family.add("SELECT count(v) AS n, round(sum(v), 2) AS s, round(avg(v), 4) AS a, min(v) AS lo, max(v) AS hi, count(*) AS all_rows FROM (SELECT CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events)")
def agg_null_semantics(spark, d):
    rows = table(spark, d, "events").select(F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
    return rows.agg(F.count("v").alias("n"), F.round(F.sum("v"), 2).alias("s"), F.round(F.avg("v"), 4).alias("a"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("all_rows"))


@_family.add("SELECT count(*) AS n, count(value) AS k, sum(value) AS s, max(value) AS hi FROM events WHERE event_id < 0")
def agg_empty_input(spark, d):
    return table(spark, d, "events").where("event_id < 0").agg(_n(), F.count("value").alias("k"), F.sum("value").alias("s"), F.max("value").alias("hi"))


@_family.add("SELECT upper(substr(p_name, 1, 1)) AS letter, CAST(sum(p_size * 2 + 1) AS BIGINT) AS total FROM part GROUP BY upper(substr(p_name, 1, 1))")
def agg_expr_group(spark, d):
    return table(spark, d, "part").groupBy(F.upper(F.substring("p_name", 1, 1)).alias("letter")).agg(F.sum(F.col("p_size") * 2 + 1).alias("total"))


@_family.add("SELECT n_regionkey, list_sort(array_agg(n_name)) AS names FROM nation GROUP BY n_regionkey")
def agg_array_agg(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))


@_family.add("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def agg_string_agg(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@_family.add("SELECT event_type, count(*) FILTER (WHERE value > 50) AS big, round(sum(value) FILTER (WHERE user_id % 2 = 0), 2) AS even FROM events GROUP BY event_type")
def agg_filter_clause(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("big"), F.round(F.sum(F.when(F.col("user_id") % 2 == 0, F.col("value"))), 2).alias("even"))


@_family.add("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def agg_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(_n())


@_family.add("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(_n())


@_family.add("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def agg_grouping_sets(spark, d):
    orders = table(spark, d, "orders")
    return orders.groupingSets([[orders.o_orderstatus], [orders.o_orderpriority], []], orders.o_orderstatus, orders.o_orderpriority).agg(_n())


@_family.add("SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_pop(value), 6) AS vp, round(median(value), 6) AS med, bool_and(value > 0) AS ba, bit_xor(user_id) AS bx FROM events GROUP BY event_type")
def agg_statistics(spark, d):
    r6 = lambda c, n: F.round(c, 6).alias(n)
    return table(spark, d, "events").groupBy("event_type").agg(
        r6(F.stddev_samp("value"), "sd"), r6(F.var_pop("value"), "vp"), r6(F.median("value"), "med"), F.bool_and(F.col("value") > 0).alias("ba"), F.bit_xor("user_id").alias("bx")
    )


@_family.add("SELECT l_suppkey, max(l_extendedprice) AS top, min(l_shipdate) AS first, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem WHERE l_quantity > 10 GROUP BY l_suppkey")
def agg_fast_numeric(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 10").groupBy("l_suppkey").agg(F.max("l_extendedprice").alias("top"), F.min("l_shipdate").alias("first"), F.sum("l_linenumber").alias("lines"))
