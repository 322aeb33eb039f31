"""Sorts and limits. Ties end on the key, ascending, so every answer is unique."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans.base import Family, table

_family = Family()
QUERIES, ORACLE_SQL = _family.queries, _family.oracle
_NULLS = "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END"


def _topn(name, sql_where, sql_order, limit, offset, where, order, columns=("o_orderkey", "o_totalprice", "o_orderstatus"), extra=None):
    picked = ", ".join(columns)
    source = f"(SELECT *, {extra} AS price FROM orders)" if extra else "orders"
    sql = f"SELECT {picked} FROM {source} {sql_where} ORDER BY {sql_order} LIMIT {limit}" + (f" OFFSET {offset}" if offset else "")

    def query(spark, d):
        rows = table(spark, d, "orders")
        if extra:
            rows = rows.withColumn("price", F.expr(extra))
        if where is not None:
            rows = rows.where(where())
        rows = rows.orderBy(*order())
        return (rows.offset(offset) if offset else rows).limit(limit).select(*columns)

    query.__name__ = name
    _family.add(sql)(query)


_key = lambda: F.col("o_orderkey").asc()
_price = lambda: F.col("o_totalprice")
_open = lambda: F.col("o_orderstatus") == "O"
_topn("topn_pk_asc", "", "o_orderkey", 100, 0, None, lambda: [_key()])
_topn("topn_pk_desc", "", "o_orderkey DESC", 100, 0, None, lambda: [F.col("o_orderkey").desc()])
_topn("topn_filter_pk_asc", "WHERE o_orderstatus = 'O'", "o_orderkey", 100, 0, _open, lambda: [_key()])
_topn("topn_non_pk_desc", "", "o_totalprice DESC NULLS LAST, o_orderkey", 100, 0, None, lambda: [_price().desc_nulls_last(), _key()])
_topn("topn_non_pk_asc", "", "o_totalprice ASC NULLS LAST, o_orderkey", 100, 0, None, lambda: [_price().asc_nulls_last(), _key()])
_topn("topn_filter_non_pk", "WHERE o_orderstatus = 'O'", "o_totalprice DESC NULLS LAST, o_orderkey", 50, 0, _open, lambda: [_price().desc_nulls_last(), _key()])
_topn("topn_offset", "WHERE o_orderstatus = 'O'", "o_totalprice DESC NULLS LAST, o_orderkey", 100, 100, _open, lambda: [_price().desc_nulls_last(), _key()])
_topn("topn_large_offset", "", "o_totalprice DESC NULLS LAST, o_orderkey", 100, 10000, None, lambda: [_price().desc_nulls_last(), _key()])
_topn("topn_nulls_last", "", "price DESC NULLS LAST, o_orderkey", 100, 0, None, lambda: [F.col("price").desc_nulls_last(), _key()], ("o_orderkey", "price"), _NULLS)
_topn("topn_nulls_first", "", "price ASC NULLS FIRST, o_orderkey", 100, 0, None, lambda: [F.col("price").asc_nulls_first(), _key()], ("o_orderkey", "price"), _NULLS)
_topn("topn_multi_pred", "WHERE o_orderstatus = 'O' AND o_totalprice < 200000", "o_totalprice DESC NULLS LAST, o_orderkey", 100, 0, lambda: _open() & (_price() < 200000), lambda: [_price().desc_nulls_last(), _key()])
_topn("topn_in", "WHERE o_custkey IN (3, 5, 8)", "o_totalprice DESC NULLS LAST, o_orderkey", 100, 0, lambda: F.col("o_custkey").isin(3, 5, 8), lambda: [_price().desc_nulls_last(), _key()])
_topn("topn_or", "WHERE o_custkey = 3 OR o_totalprice > 300000", "o_totalprice DESC NULLS LAST, o_orderkey", 100, 0, lambda: (F.col("o_custkey") == 3) | (_price() > 300000), lambda: [_price().desc_nulls_last(), _key()])
_topn("topn_narrow", "WHERE o_orderstatus = 'O'", "o_totalprice DESC NULLS LAST, o_orderkey", 100, 0, _open, lambda: [_price().desc_nulls_last(), _key()], ("o_orderkey",))
_topn("topn_multi_key", "", "o_orderstatus DESC, o_totalprice ASC, o_orderkey", 60, 0, None, lambda: [F.col("o_orderstatus").desc(), _price().asc(), _key()])
_topn("topn_expression", "", "o_custkey % 10, o_totalprice DESC, o_orderkey", 60, 0, None, lambda: [F.col("o_custkey") % 10, _price().desc(), _key()])
