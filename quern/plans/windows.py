"""Window functions: ranks, frames, neighbours, and QUALIFY as a filter over a window."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators.joins import global_ranks
from quern.plans.base import Family, table

_family = Family()
QUERIES, ORACLE_SQL = _family.queries, _family.oracle
_SQL = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)"
_by = lambda: Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
_time = lambda: Window.partitionBy("user_id").orderBy("ts", "event_id")


@_family.add(f"SELECT o_orderkey, row_number() {_SQL} AS rn FROM orders")
def win_row_number(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(_by()).cast("long").alias("rn"))


@_family.add("SELECT n_nationkey, rank() OVER (ORDER BY n_regionkey) AS r, dense_rank() OVER (ORDER BY n_regionkey) AS dr, round(percent_rank() OVER (ORDER BY n_regionkey), 6) AS pr, round(cume_dist() OVER (ORDER BY n_regionkey), 6) AS cd FROM nation")
def win_rank_dense(spark, d):
    ranked = global_ranks(table(spark, d, "nation"), "n_regionkey")
    return ranked.select("n_nationkey", F.col("rank").alias("r"), F.col("dense_rank").alias("dr"), F.round("percent_rank", 6).alias("pr"), F.round("cume_dist", 6).alias("cd"))


@_family.add("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS running FROM events")
def win_running_sum(spark, d):
    return table(spark, d, "events").select("event_id", F.round(F.sum("value").over(_time().rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"))


@_family.add("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS mean FROM events")
def win_moving_avg_rows(spark, d):
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(_time().rowsBetween(-2, 1)), 4).alias("mean"))


@_family.add("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS near FROM orders")
def win_range_frame(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rangeBetween(-500, 0)
    return table(spark, d, "orders").select("o_orderkey", F.count(F.lit(1)).over(w).alias("near"))


@_family.add("SELECT event_id, lag(value) OVER w AS prev, lead(value, 2, -1.0) OVER w AS next2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win_lag_lead(spark, d):
    return table(spark, d, "events").select("event_id", F.lag("value").over(_time()).alias("prev"), F.lead("value", 2, -1.0).over(_time()).alias("next2"))


@_family.add(f"SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() {_SQL} <= 2")
def win_qualify_topk(spark, d):
    return table(spark, d, "orders").withColumn("rn", F.row_number().over(_by())).where("rn <= 2").select("o_custkey", "o_orderkey")


@_family.add("SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS quarter FROM orders")
def win_ntile(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.ntile(4).over(Window.partitionBy("o_orderstatus").orderBy("o_totalprice", "o_orderkey")).cast("long").alias("quarter"))


@_family.add("SELECT event_id, first_value(event_type) OVER w AS f, last_value(event_type) OVER w AS l, nth_value(event_type, 2) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def win_first_last(spark, d):
    w = _time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, d, "events").select("event_id", F.first("event_type").over(w).alias("f"), F.last("event_type").over(w).alias("l"), F.nth_value("event_type", 2).over(w).alias("s"))
