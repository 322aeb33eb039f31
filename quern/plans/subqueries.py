"""Sub-queries, common table expressions, set operations, views."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans.base import Family, table

_family = Family()
QUERIES, ORACLE_SQL = _family.queries, _family.oracle


def _sql(name: str, text: str, *tables: str, oracle: str | None = None):
    """A query that is SQL in both engines; {t} stands for table t in Spark."""

    def query(spark, d):
        return spark.sql(text, **{t: table(spark, d, t) for t in tables})

    query.__name__ = name
    plain = text
    for t in tables:
        plain = plain.replace("{" + t + "}", t)
    _family.add(oracle or plain)(query)


_sql("sub_scalar_avg", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM {orders})", "orders")
_sql("sub_scalar_row", "SELECT (SELECT count(*) FROM {orders}) AS orders_n, (SELECT count(*) FROM {customer}) AS customers_n, (SELECT max(p_size) FROM {part}) AS size", "orders", "customer", "part")
_sql("sub_correlated_scalar", "SELECT c_custkey, (SELECT max(o_totalprice) FROM {orders} WHERE o_custkey = c_custkey) AS most FROM {customer}", "orders", "customer")
_sql("sub_derived", "SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM {orders} GROUP BY o_custkey) t WHERE n > 10", "orders")
_sql("cte_filter_count", "WITH big AS (SELECT * FROM {orders} WHERE o_totalprice > 100000) SELECT o_orderstatus, count(*) AS n FROM big GROUP BY o_orderstatus", "orders")
_sql("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
_sql("set_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier}", "customer", "supplier")
_sql("set_union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey AS k FROM {supplier}", "customer", "supplier")
_sql("set_intersect", "SELECT o_custkey AS k FROM {orders} WHERE o_totalprice > 200000 INTERSECT SELECT c_custkey AS k FROM {customer} WHERE c_acctbal > 5000", "orders", "customer")
_sql("set_except", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey AS k FROM {orders}", "orders", "customer")
_sql("set_intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey AS k FROM {supplier}", "customer", "supplier")
_sql("set_except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey AS k FROM {supplier}", "customer", "supplier")
_sql("distinct_order", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM {orders} ORDER BY o_orderpriority, o_orderstatus", "orders")


@_family.add("SELECT n_name, count(*) AS n FROM (SELECT * FROM customer WHERE c_acctbal > 0) JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def view_expand(spark, d):
    table(spark, d, "customer").where("c_acctbal > 0").createOrReplaceTempView("quern_rich")
    return spark.sql("SELECT n_name, count(*) AS n FROM quern_rich JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name", nation=table(spark, d, "nation"))


@_family.add("SELECT event_type, lower(event_type) AS low, count(*) AS n FROM events GROUP BY 1, 2")
def group_by_ordinal(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.lower("event_type").alias("low")).agg(F.count(F.lit(1)).alias("n"))
