"""Types, data changes, transactions, catalogs and dialect text, run through the engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.engine import Engine
from quern.plans.base import Family, table
from quern.types import parse_type

_family = Family()
QUERIES, ORACLE_SQL = _family.queries, _family.oracle


def _engine(spark, d, dialect="postgres", **keys):
    """An engine with its own copies of small tables: name=primary key."""
    engine = Engine(spark, dialect)
    for name, key in keys.items():
        engine.adopt(name, table(spark, d, name), key)
    return engine


def _typed(name, source, key, cases, oracle):
    """Stored form and SQLSTATE of values of one column: cases map output names to (type, expression)."""

    def query(spark, d):
        rows = table(spark, d, source)
        out = [F.col(key)]
        for label, (kind, expression) in cases.items():
            t, x = parse_type(kind), F.expr(expression)
            bad = t.violation(x)
            out += [F.when(bad.isNull(), t.coerce(x)).alias(label), bad.alias(label + "_state")]
        return rows.select(*out)

    query.__name__ = name
    _family.add(oracle)(query)


_ABC = "o_orderkey % 70000"
_typed("ty_int_ranges", "orders", "o_orderkey", {"small": ("smallint", "o_custkey * 60")}, """
    SELECT o_orderkey, CASE WHEN o_custkey * 60 <= 32767 THEN CAST(o_custkey * 60 AS INT) END AS small, CASE WHEN o_custkey * 60 > 32767 THEN '22003' END AS small_state FROM orders
""")  # fmt: skip
_typed("ty_unsigned_bigint", "orders", "o_orderkey", {"u": ("bigint unsigned", "o_orderkey - 100")}, """
    SELECT o_orderkey, CASE WHEN o_orderkey >= 100 THEN CAST(o_orderkey - 100 AS DECIMAL(20, 0)) END AS u, CASE WHEN o_orderkey < 100 THEN '22003' END AS u_state FROM orders
""")  # fmt: skip
_typed("ty_decimal", "part", "p_partkey", {"m": ("decimal(4,0)", "p_partkey * 7")}, """
    SELECT p_partkey, CASE WHEN p_partkey * 7 < 10000 THEN CAST(p_partkey * 7 AS DECIMAL(4, 0)) END AS m, CASE WHEN p_partkey * 7 >= 10000 THEN '22003' END AS m_state FROM part
""")  # fmt: skip
_typed("ty_char_pad", "nation", "n_nationkey", {"c": ("char(8)", "n_name")}, """
    SELECT n_nationkey, CASE WHEN length(n_name) <= 8 THEN rpad(n_name, 8, ' ') END AS c, CASE WHEN length(n_name) > 8 THEN '22001' END AS c_state FROM nation
""")  # fmt: skip
_typed("ty_varchar_limit", "nation", "n_nationkey", {"v": ("varchar(6)", "n_name")}, """
    SELECT n_nationkey, CASE WHEN length(n_name) <= 6 THEN n_name END AS v, CASE WHEN length(n_name) > 6 THEN '22001' END AS v_state FROM nation
""")  # fmt: skip
_typed("ty_year", "part", "p_partkey", {"y": ("year", "p_size * 2")}, """
    SELECT p_partkey, CASE WHEN p_size * 2 <= 69 THEN 2000 + p_size * 2 WHEN p_size * 2 <= 99 THEN 1900 + p_size * 2 END AS y, CASE WHEN p_size * 2 > 99 THEN '22003' END AS y_state FROM part
""")  # fmt: skip
_typed("ty_bit", "part", "p_partkey", {"b": ("bit(4)", "p_size")}, """
    SELECT p_partkey, CASE WHEN p_size < 16 THEN CAST(p_size AS BIGINT) END AS b, CASE WHEN p_size >= 16 THEN '22001' END AS b_state FROM part
""")  # fmt: skip
_typed("ty_enum_set", "customer", "c_custkey", {"e": ("enum('BUILDING','MACHINERY')", "c_mktsegment"), "s": ("set('a','b')", "CASE WHEN c_custkey % 3 = 0 THEN 'a,b' WHEN c_custkey % 3 = 1 THEN 'a,a' ELSE 'b' END")}, """
    SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS e, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN '22P02' END AS e_state,
           CASE c_custkey % 3 WHEN 0 THEN 'a,b' WHEN 2 THEN 'b' END AS s, CASE WHEN c_custkey % 3 = 1 THEN '22P02' END AS s_state FROM customer
""")  # fmt: skip
_typed("ty_uuid", "nation", "n_nationkey", {"u": ("uuid", "CASE WHEN n_nationkey % 2 = 0 THEN 'A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11' ELSE n_name END")}, """
    SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11' END AS u, CASE WHEN n_nationkey % 2 = 1 THEN '22P02' END AS u_state FROM nation
""")  # fmt: skip
_typed("ty_bool_parse", "nation", "n_nationkey", {"b": ("boolean", "CASE n_nationkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'OFF' WHEN 2 THEN '1' ELSE 'maybe' END")}, """
    SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE END AS b, CASE WHEN n_nationkey % 4 = 3 THEN '22P02' END AS b_state FROM nation
""")  # fmt: skip


@_family.add("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, upper(n_name), n_regionkey FROM nation WHERE n_regionkey = 1")
def dml_insert_select(spark, d):
    e = _engine(spark, d, nation="n_nationkey")
    e.sql("INSERT INTO nation SELECT n_nationkey + 100, upper(n_name), n_regionkey FROM nation WHERE n_regionkey = 1")
    return e.query("SELECT * FROM nation")


@_family.add("SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN c_acctbal * 2 + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey < 5 THEN concat(c_name, '!') ELSE c_name END AS c_name FROM customer")
def dml_update_expr(spark, d):
    e = _engine(spark, d, customer="c_custkey")
    e.sql("UPDATE customer SET c_acctbal = c_acctbal * 2 + 1, c_name = concat(c_name, '!') WHERE c_nationkey < 5")
    return e.query("SELECT c_custkey, c_acctbal, c_name FROM customer")


@_family.add("SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment = 'BUILDING')")
def dml_delete(spark, d):
    e = _engine(spark, d, customer="c_custkey")
    e.sql("DELETE FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'")
    return e.query("SELECT c_custkey FROM customer")


@_family.add("SELECT n_nationkey, CASE WHEN n_nationkey < 10 THEN concat(n_name, '/', 'x') ELSE n_name END AS n_name FROM nation UNION ALL SELECT 100 + n_nationkey, 'x' FROM nation WHERE n_nationkey < 3")
def dml_upsert_update(spark, d):
    e = _engine(spark, d, nation="n_nationkey")
    e.sql("INSERT INTO nation SELECT n_nationkey, 'x', 0 FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey + 100, 'x', 0 FROM nation WHERE n_nationkey < 3 ON CONFLICT (n_nationkey) DO UPDATE SET n_name = concat(nation.n_name, '/', EXCLUDED.n_name)")
    return e.query("SELECT n_nationkey, n_name FROM nation")


@_family.add("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 77, 'new'")
def dml_upsert_nothing(spark, d):
    e = _engine(spark, d, region="r_regionkey")
    e.sql("INSERT INTO region VALUES (0, 'zero'), (77, 'new'), (77, 'again') ON CONFLICT (r_regionkey) DO NOTHING")
    return e.query("SELECT r_regionkey, r_name FROM region")


@_family.add("SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'one' ELSE r_name END AS r_name FROM region UNION ALL SELECT 9, 'nine'")
def dml_replace(spark, d):
    e = _engine(spark, d, "mysql", region="r_regionkey")
    e.sql("REPLACE INTO region VALUES (1, 'uno'), (9, 'nine'), (1, 'one')")
    return e.query("SELECT r_regionkey, r_name FROM region")


@_family.add("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 9, 'nine'")
def dml_insert_ignore(spark, d):
    e = _engine(spark, d, "mysql", region="r_regionkey")
    e.sql("INSERT IGNORE INTO region VALUES (1, 'uno'), (9, 'nine')")
    return e.query("SELECT r_regionkey, r_name FROM region")


@_family.add("SELECT n_nationkey, lower(n_name) AS name, n_regionkey + 10 AS r FROM nation WHERE n_nationkey > 15")
def dml_returning(spark, d):
    e = _engine(spark, d, nation="n_nationkey")
    return e.query("UPDATE nation SET n_regionkey = n_regionkey + 10 WHERE n_nationkey > 15 RETURNING n_nationkey, lower(n_name) AS name, n_regionkey AS r")


@_family.add("SELECT n_nationkey, CASE WHEN n_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2 ORDER BY n_nationkey DESC LIMIT 2) THEN 'last' ELSE n_name END AS n_name FROM nation")
def dml_update_limit(spark, d):
    e = _engine(spark, d, "mysql", nation="n_nationkey")
    e.sql("UPDATE nation SET n_name = 'last' WHERE n_regionkey = 2 ORDER BY n_nationkey DESC LIMIT 2")
    return e.query("SELECT n_nationkey, n_name FROM nation")


@_family.add("SELECT * FROM (VALUES ('check', '23514'), ('foreign key', '23503'), ('not null', '23502'), ('primary key', '23505'), ('unique', '23505')) AS v(rule, state)")
def dml_constraints_violations(spark, d):
    from quern.errors import SqlError

    e = _engine(spark, d, region="r_regionkey")
    e.sql("CREATE TABLE town (id INT PRIMARY KEY, name TEXT NOT NULL UNIQUE, size INT CHECK (size > 0), region INT REFERENCES region(r_regionkey))")
    e.sql("INSERT INTO town VALUES (1, 'a', 5, 0)")
    out = []
    for rule, row in (("check", "(2, 'b', 0, 0)"), ("foreign key", "(2, 'b', 1, 99)"), ("not null", "(2, NULL, 1, 0)"), ("primary key", "(1, 'b', 1, 0)"), ("unique", "(2, 'a', 1, 0)")):
        try:
            e.sql(f"INSERT INTO town VALUES {row}")
            out.append((rule, None))
        except SqlError as x:
            out.append((rule, x.sqlstate))
    return spark.createDataFrame(out, "rule string, state string")


@_family.add("SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 0")
def txn_savepoint(spark, d):
    e = _engine(spark, d, region="r_regionkey")
    e.sql("BEGIN")
    e.sql("DELETE FROM region WHERE r_regionkey = 0")
    e.sql("SAVEPOINT one")
    e.sql("DELETE FROM region")
    e.sql("ROLLBACK TO SAVEPOINT one")
    e.sql("COMMIT")
    return e.query("SELECT r_regionkey, r_name FROM region")


@_family.add("SELECT * FROM (VALUES ('n_name', 2, 'text'), ('n_nationkey', 1, 'integer'), ('n_regionkey', 3, 'integer')) AS v(column_name, ordinal_position, data_type)")
def cat_information_schema_columns(spark, d):
    return _engine(spark, d, nation="n_nationkey").query("SELECT column_name, ordinal_position, data_type FROM information_schema.columns WHERE table_name = 'nation'")


@_family.add("SELECT * FROM (VALUES ('nation', 'r', 3), ('nation_pkey', 'i', 1)) AS v(relname, relkind, relnatts)")
def cat_pg_class(spark, d):
    return _engine(spark, d, nation="n_nationkey").query("SELECT relname, relkind, relnatts FROM pg_catalog.pg_class")


@_family.add("SELECT 'c_name' AS attname, 0.0 AS null_frac UNION ALL SELECT 'half', round(avg(CASE WHEN c_custkey % 2 = 0 THEN 1.0 ELSE 0.0 END), 6) FROM customer")
def cat_pg_stats(spark, d):
    e = _engine(spark, d)
    e.adopt("c", table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 != 0, F.lit(1)).alias("half")), "c_custkey")
    e.sql("ANALYZE c")
    return e.query("SELECT attname, round(null_frac, 6) AS null_frac FROM pg_stats WHERE tablename = 'c' AND attname IN ('half', 'c_name')")


@_family.add("SELECT * FROM (VALUES ('r_name', 'text', 'YES', ''), ('r_regionkey', 'int', 'NO', 'PRI')) AS v(Field, Type, \"Null\", \"Key\")")
def cat_show_columns(spark, d):
    return _engine(spark, d, "mysql", region="r_regionkey").query("SHOW COLUMNS FROM region").select("Field", "Type", "Null", "Key")


@_family.add("SELECT 'Index Scan using region_pkey on region' AS line")
def cat_explain_shape(spark, d):
    e = _engine(spark, d, region="r_regionkey")
    return e.query("EXPLAIN SELECT * FROM region WHERE r_regionkey = 1").limit(1).toDF("line")


@_family.add("SELECT o_custkey, o_orderkey, o_orderkey // 10 AS tens FROM orders WHERE (o_totalprice > 100000) <> (o_orderstatus = 'F') ORDER BY o_orderkey LIMIT 20 OFFSET 5")
def sql_mysql_text(spark, d):
    e = _engine(spark, d, "mysql")
    e.attach("orders", f"{d}/orders.parquet")
    return e.query("SELECT `o_custkey`, o_orderkey, o_orderkey DIV 10 AS tens FROM orders WHERE o_totalprice > 100000 XOR o_orderstatus = \"F\" ORDER BY o_orderkey LIMIT 5, 20 -- a page")


@_family.add("SELECT event_id, CAST(props ->> '$.k' AS INT) AS k FROM events WHERE event_type ILIKE 'c%' AND user_id = ANY([1, 2, 3])")
def sql_postgres_text(spark, d):
    e = _engine(spark, d)
    e.attach("events", f"{d}/events.parquet")
    return e.query("SELECT event_id, (props->>'k')::int4 AS k FROM public.events WHERE event_type ~* '^c' AND user_id = ANY(ARRAY[1, 2, 3]) FOR UPDATE")
