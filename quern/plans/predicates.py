"""Predicates under three-valued logic."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans.base import Family, table

_family = Family()
QUERIES, ORACLE_SQL = _family.queries, _family.oracle

#: acctbal with NULLs: the same expression on both sides.
_SOME = "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END"


def _customer(spark, d):
    return table(spark, d, "customer").withColumn("bal", F.expr(_SOME))


_SQL = f"(SELECT *, {_SOME} AS bal FROM customer)"


@_family.add(f"SELECT c_custkey FROM {_SQL} WHERE bal BETWEEN 0 AND 500 OR bal NOT BETWEEN -200 AND 9000")
def pred_between_or_not_between(spark, d):
    bal = F.col("bal")
    return _customer(spark, d).where(bal.between(0, 500) | ~bal.between(-200, 9000)).select("c_custkey")


@_family.add("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%e%' AND p_name LIKE '_%'")
def pred_like(spark, d):
    return table(spark, d, "part").where(F.col("p_name").like("%e%") & F.col("p_name").like("_%")).select("p_partkey", "p_name")


@_family.add("SELECT p_partkey FROM part WHERE replace(p_type, ' ', '_') LIKE '%!_%' ESCAPE '!'")
def pred_like_escape(spark, d):
    return table(spark, d, "part").where(F.expr("replace(p_type, ' ', '_') LIKE '%!_%' ESCAPE '!'")).select("p_partkey")


@_family.add("SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE '%build%'")
def pred_ilike(spark, d):
    return table(spark, d, "customer").where(F.col("c_mktsegment").ilike("%build%")).select("c_custkey")


@_family.add("SELECT c_custkey FROM customer WHERE c_mktsegment NOT LIKE 'A%' AND c_nationkey NOT IN (1, 2, 3)")
def pred_not_like_not_in(spark, d):
    return table(spark, d, "customer").where(~F.col("c_mktsegment").like("A%") & ~F.col("c_nationkey").isin(1, 2, 3)).select("c_custkey")


@_family.add(f"SELECT c_custkey, bal IS NULL AS missing FROM {_SQL} WHERE bal IS NULL OR bal > 9000")
def pred_is_null(spark, d):
    return _customer(spark, d).where(F.col("bal").isNull() | (F.col("bal") > 9000)).select("c_custkey", F.col("bal").isNull().alias("missing"))


@_family.add(f"SELECT c_custkey, (bal > 100) IS TRUE AS t, (bal > 100) IS NOT FALSE AS nf FROM {_SQL}")
def pred_is_true_false(spark, d):
    return _customer(spark, d).selectExpr("c_custkey", "(bal > 100) IS TRUE AS t", "(bal > 100) IS NOT FALSE AS nf")


@_family.add("SELECT c_custkey, (CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END) IS NOT DISTINCT FROM (CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 3 END) AS same FROM customer")
def pred_null_safe_eq(spark, d):
    key = F.col("c_custkey")
    a, b = F.when(key % 5 != 0, F.col("c_nationkey")), F.when(key % 10 != 0, F.lit(3))
    return table(spark, d, "customer").select("c_custkey", a.eqNullSafe(b).alias("same"))


@_family.add("SELECT vec_id FROM embeddings WHERE label = ANY([1, 3, 5])")
def pred_any_array(spark, d):
    return table(spark, d, "embeddings").where(F.exists(F.array(*map(F.lit, (1, 3, 5))), lambda x: F.col("label") == x)).select("vec_id")


@_family.add("SELECT vec_id FROM embeddings WHERE label > 1 AND label > 3")
def pred_all_array(spark, d):
    return table(spark, d, "embeddings").where(F.forall(F.array(F.lit(1), F.lit(3)), lambda x: F.col("label") > x)).select("vec_id")


@_family.add("SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '^Brand.*[13]$')")
def pred_regexp(spark, d):
    return table(spark, d, "part").where(F.col("p_brand").rlike("^Brand.*[13]$")).select("p_partkey")


@_family.add("SELECT p_partkey FROM part WHERE xor(CAST(p_size > 25 AS INT), CAST(p_retailprice > 1200 AS INT)) = 1")
def pred_xor(spark, d):
    return table(spark, d, "part").where((F.col("p_size") > 25) != (F.col("p_retailprice") > 1200)).select("p_partkey")


@_family.add("""
    SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'small' WHEN o_totalprice < 50000 THEN CASE o_orderstatus WHEN 'F' THEN 'medium-done' ELSE 'medium-open' END ELSE 'large' END AS bucket FROM orders
""")
def pred_case_nested(spark, d):
    price = F.col("o_totalprice")
    inner = F.when(F.col("o_orderstatus") == "F", "medium-done").otherwise("medium-open")
    return table(spark, d, "orders").select("o_orderkey", F.when(price < 1000, "small").when(price < 50000, inner).otherwise("large").alias("bucket"))


@_family.add(f"SELECT c_custkey FROM {_SQL} WHERE NOT (bal > 100 AND c_nationkey < 12)")
def pred_boolean_not(spark, d):
    return _customer(spark, d).where(~((F.col("bal") > 100) & (F.col("c_nationkey") < 12))).select("c_custkey")


@_family.add(f"SELECT c_custkey FROM {_SQL} WHERE bal NOT IN (1, 2, NULL)")
def pred_not_in_null(spark, d):
    return _customer(spark, d).where(F.expr("bal NOT IN (1, 2, NULL)")).select("c_custkey")


@_family.add("SELECT event_id, CAST(CAST(ts AS VARCHAR) AS TIMESTAMP) AS back, CAST(value AS BIGINT) AS v FROM events")
def pred_cast(spark, d):
    return table(spark, d, "events").select("event_id", F.col("ts").cast("string").cast("timestamp_ntz").alias("back"), F.rint("value").cast("long").alias("v"))
