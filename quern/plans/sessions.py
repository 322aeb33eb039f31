"""Statements of whole sessions: changes, definitions, loads, prepared statements, catalogs, and functions as SQL text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.engine import Engine, warehouse_folder
from quern.errors import SqlError
from quern.plans import scalars
from quern.plans.base import Family, table
from quern.plans.statements import _engine
from quern.streaming import ingest

_family = Family()
QUERIES, ORACLE_SQL = _family.queries, _family.oracle


def _state(engine, text: str) -> str | None:
    """The SQLSTATE that a statement fails with."""
    try:
        engine.sql(text)
    except SqlError as e:
        return e.sqlstate
    return None


def _told(spark, rows: list[tuple], schema: str):
    return spark.createDataFrame(rows, schema)


def _folder(spark) -> str:
    return f"{warehouse_folder(spark)}/load/{uuid.uuid4().hex}"


def _values(*rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)})"


# -- changes of rows -----------------------------------------------------------


@_family.add("SELECT 1 AS id, 'a' AS name, 5 AS size UNION ALL SELECT 2, 'none', 7 UNION ALL SELECT 3, NULL, 5 UNION ALL SELECT 10 + n_nationkey, n_name, 5 FROM nation")
def dml_insert_values_default(spark, d):
    e = _engine(spark, d, nation="n_nationkey")
    e.sql("CREATE TABLE t (id INT PRIMARY KEY, name TEXT DEFAULT 'none', size INT DEFAULT 2 + 3)")
    e.sql("INSERT INTO t VALUES (1, 'a', DEFAULT), (2, DEFAULT, 7)")
    e.sql("INSERT INTO t (name, id) VALUES (NULL, 3)")
    e.sql("INSERT INTO t (id, name) SELECT 10 + n_nationkey, n_name FROM nation")
    return e.query("SELECT id, name, size FROM t")


@_family.add("SELECT 1 AS id, 'one' AS name UNION ALL SELECT r_regionkey + 2, r_name FROM region")
def dml_insert_set(spark, d):
    e = _engine(spark, d, "mysql", region="r_regionkey")
    e.sql("CREATE TABLE t (id INT AUTO_INCREMENT PRIMARY KEY, name VARCHAR(30))")
    e.sql("INSERT INTO t SET name = 'one'")
    e.sql("INSERT INTO t SELECT r_regionkey + 2, r_name FROM region")
    return e.query("SELECT id, name FROM t")


@_family.add("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN concat(n_name, '+') ELSE n_name END AS n_name FROM nation UNION ALL SELECT 500, 'new'")
def dml_on_duplicate_key(spark, d):
    e = _engine(spark, d, "mysql", nation="n_nationkey")
    e.sql("INSERT INTO nation SELECT n_nationkey, '+', 0 FROM nation WHERE n_nationkey % 2 = 0 ON DUPLICATE KEY UPDATE n_name = concat(n_name, VALUES(n_name))")
    e.sql("INSERT INTO nation VALUES (500, 'new', 1) ON DUPLICATE KEY UPDATE n_name = 'old'")
    return e.query("SELECT n_nationkey, n_name FROM nation")


@_family.add(_values("('insert', 1)", "('changed', 2)", "('unchanged', 0)", "('both', 3)", "('replace', 2)", "('ignore', 1)") + " AS v(what, affected)")
def dml_affected_rows(spark, d):
    e = _engine(spark, d, "mysql", region="r_regionkey")
    run = lambda text: e.sql("INSERT INTO region " + text + " ON DUPLICATE KEY UPDATE r_name = VALUES(r_name)").affected
    out = [("insert", run("VALUES (50, 'a')")), ("changed", run("VALUES (50, 'b')")), ("unchanged", run("VALUES (50, 'b')")), ("both", run("VALUES (50, 'c'), (51, 'd')"))]
    out += [("replace", e.sql("REPLACE INTO region VALUES (50, 'x')").affected), ("ignore", e.sql("INSERT IGNORE INTO region VALUES (50, 'y'), (52, 'z')").affected)]
    return _told(spark, out, "what string, affected int")


@_family.add("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'now' ELSE 'then' END AS at, n_name FROM nation")
def dml_on_update_timestamp(spark, d):
    e = _engine(spark, d, "mysql", nation="n_nationkey")
    e.sql("CREATE TABLE t (id INT PRIMARY KEY, name TEXT, r INT, at DATETIME DEFAULT '2001-01-01 00:00:00' ON UPDATE CURRENT_TIMESTAMP)")
    e.sql("INSERT INTO t (id, name, r) SELECT n_nationkey, n_name, n_regionkey FROM nation")
    e.sql("UPDATE t SET r = r + 1 WHERE r = 1")
    return e.query("SELECT id AS n_nationkey, CASE WHEN at > '2020-01-01' THEN 'now' ELSE 'then' END AS at, name AS n_name FROM t")


@_family.add(_values("('a', 1, 'again')") + " AS v(t, id, name)")
def dml_truncate(spark, d):
    e = _engine(spark, d, "mysql")
    for name in "ab":
        e.sql(f"CREATE TABLE {name} (id INT AUTO_INCREMENT PRIMARY KEY, name TEXT)")
        e.sql(f"INSERT INTO {name} (name) VALUES ('x'), ('y')")
    e.sql("TRUNCATE TABLE a")
    e.sql("TRUNCATE TABLE b")
    e.sql("INSERT INTO a (name) VALUES ('again')")
    return e.query("SELECT 'a' AS t, id, name FROM a UNION ALL SELECT 'b', id, name FROM b")


@_family.add("SELECT 1 AS id, 110 AS u UNION ALL SELECT 2, 20 UNION ALL SELECT 3, 30")
def dml_update_limit_referred(spark, d):
    e = _engine(spark, d, "mysql")
    e.sql("CREATE TABLE p (id INT PRIMARY KEY, u INT UNIQUE)")
    e.sql("CREATE TABLE c (id INT PRIMARY KEY, u INT, FOREIGN KEY (u) REFERENCES p(u))")
    e.sql("INSERT INTO p VALUES (1, 10), (2, 20), (3, 30)")
    e.sql("INSERT INTO c VALUES (1, 30)")
    e.sql("UPDATE p SET u = u + 100 ORDER BY id LIMIT 1")
    return e.query("SELECT id, u FROM p")


# -- definitions ---------------------------------------------------------------


@_family.add("SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey")
def ddl_create_table_as(spark, d):
    e = _engine(spark, d)
    e.attach("orders", f"{d}/orders.parquet")
    e.sql("CREATE TABLE big AS SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey")
    return e.query("SELECT * FROM big")


@_family.add(_values("('like', NULL)", "('duplicate', '23505')", "('not null', '23502')", "('again', '42P07')", "('no schema', '3F000')", "('column twice', '42701')") + " AS v(what, state)")
def ddl_create_table(spark, d):
    e = _engine(spark, d, "mysql")
    e.sql("CREATE TABLE a (id INT PRIMARY KEY, name VARCHAR(9) NOT NULL, KEY by_name (name), FULLTEXT KEY words (name), UNIQUE KEY once (name))")
    states = [("like", _state(e, "CREATE TABLE b LIKE a")), ("duplicate", _state(e, "INSERT INTO b VALUES (1, 'x'), (2, 'x')")), ("not null", _state(e, "INSERT INTO b VALUES (1, NULL)"))]
    states += [("again", _state(e, "CREATE TABLE b (id INT)")), ("no schema", _state(e, "CREATE TABLE none.b (id INT)")), ("column twice", _state(e, "CREATE TABLE c (id INT, id INT)"))]
    return _told(spark, states, "what string, state string")


@_family.add("SELECT n_nationkey AS id, n_name AS label, CAST(n_regionkey AS VARCHAR) AS region, 'new' AS extra, CASE WHEN n_nationkey = 0 THEN 1 END AS later FROM nation")
def ddl_alter_table(spark, d):
    e = _engine(spark, d, nation="n_nationkey")
    e.sql("CREATE TABLE t (id INT PRIMARY KEY, name TEXT, region INT, gone INT)")
    e.sql("INSERT INTO t SELECT n_nationkey, n_name, n_regionkey, 1 FROM nation")
    for text in ("ADD COLUMN extra TEXT DEFAULT 'new'", "RENAME COLUMN name TO label", "ALTER COLUMN region TYPE TEXT", "DROP COLUMN gone", "ADD COLUMN later INT", "ADD CONSTRAINT few CHECK (id < 1000)", "ALTER COLUMN label SET NOT NULL", "RENAME TO s"):
        e.sql(f"ALTER TABLE {'t'} {text}")
    e.sql("UPDATE s SET later = 1 WHERE id = 0")
    return e.query("SELECT id, label, region, extra, later FROM s")


@_family.add(_values("('unique', '23505')", "('made', NULL)", "('refused', '23505')", "('dropped', NULL)", "('hash', '0A000')", "('missing', '42P01')", "('if exists', NULL)") + " AS v(what, state)")
def ddl_index(spark, d):
    e = _engine(spark, d, nation="n_nationkey")
    out = [("unique", _state(e, "CREATE UNIQUE INDEX one ON nation (n_regionkey)")), ("made", _state(e, "CREATE UNIQUE INDEX two ON nation (n_name, n_regionkey)")), ("refused", _state(e, "INSERT INTO nation SELECT n_nationkey + 100, n_name, n_regionkey FROM nation"))]
    out += [("dropped", _state(e, "DROP INDEX two")), ("hash", _state(e, "CREATE INDEX three ON nation USING hash (n_name)")), ("missing", _state(e, "DROP INDEX two")), ("if exists", _state(e, "DROP INDEX IF EXISTS two"))]
    return _told(spark, out, "what string, state string")


@_family.add("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def ddl_view_and_schema(spark, d):
    e = _engine(spark, d, nation="n_nationkey", region="r_regionkey")
    e.sql("CREATE SCHEMA s")
    e.sql("CREATE TABLE s.region AS SELECT * FROM region WHERE r_name <> 'ASIA'")
    e.sql("CREATE VIEW v AS SELECT 1 AS x")
    e.sql("CREATE OR REPLACE VIEW v AS SELECT n_name, r_name FROM nation JOIN s.region r ON n_regionkey = r.r_regionkey")
    return e.query("SELECT n_name, r_name FROM v")


@_family.add(_values("('table', '42P01')", "('view', '42P01')", "('sequence', '42P01')", "('schema', '42P01')", "('referred', '2BP01')", "('not empty', '2BP01')", "('if exists', NULL)") + " AS v(what, state)")
def ddl_drop(spark, d):
    e = _engine(spark, d)
    out = [(k, _state(e, f"DROP {k.upper()} nothing")) for k in ("table", "view", "sequence", "schema")]
    e.sql("CREATE TABLE p (id INT PRIMARY KEY); CREATE TABLE c (id INT PRIMARY KEY, p INT REFERENCES p(id)); CREATE SCHEMA s; CREATE TABLE s.t (id INT)")
    out += [("referred", _state(e, "DROP TABLE p")), ("not empty", _state(e, "DROP SCHEMA s")), ("if exists", _state(e, "DROP TABLE IF EXISTS nothing, c, p"))]
    return _told(spark, out, "what string, state string")


@_family.add("SELECT 500 + 2 * CAST(row_number() OVER () - 1 AS INTEGER) AS n FROM nation UNION ALL SELECT 550")
def seq_named_default(spark, d):
    e = _engine(spark, d, nation="n_nationkey")
    e.sql("CREATE SEQUENCE s START WITH 500 INCREMENT BY 2")
    e.sql("CREATE TABLE t (name TEXT, n BIGINT DEFAULT nextval('s'))")
    e.sql("INSERT INTO t (name) SELECT n_name FROM nation")
    return e.query("SELECT CAST(n AS INT) AS n FROM t").union(e.query("SELECT nextval('s')").select(F.col("nextval").cast("int")))


@_family.add("SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, CAST(1 + n_nationkey AS BIGINT) AS place FROM nation UNION ALL SELECT 1000, 26 UNION ALL SELECT 1001, 27")
def seq_serial(spark, d):
    e = _engine(spark, d, nation="n_nationkey")
    e.sql("CREATE TABLE t (id BIGSERIAL PRIMARY KEY, place BIGINT)")
    e.sql("INSERT INTO t (place) SELECT 1 + n_nationkey FROM nation ORDER BY n_nationkey")
    e.sql("INSERT INTO t VALUES (1000, 26)")
    e.sql("INSERT INTO t (place) VALUES (27)")
    return e.query("SELECT id, place FROM t")


# -- sessions ------------------------------------------------------------------


@_family.add(_values("('read only', '25006')", "('savepoint', '3B001')", "('outside', '25P01')", "('conflict', '40001')", "('for update', NULL)", "('search path', NULL)", "('unknown', '42P01')", "('limit', '2201X')") + " AS v(what, state)")
def session_states(spark, d):
    e = _engine(spark, d, region="r_regionkey")
    e.sql("BEGIN READ ONLY")
    out = [("read only", _state(e, "DELETE FROM region")), ("savepoint", _state(e, "ROLLBACK TO SAVEPOINT none"))]
    e.sql("ROLLBACK")
    out.append(("outside", _state(e, "SAVEPOINT one")))
    other = e.session()
    e.sql("BEGIN")
    e.sql("DELETE FROM region WHERE r_regionkey = 1")
    other.sql("DELETE FROM region WHERE r_regionkey = 2")
    out += [("conflict", _state(e, "COMMIT")), ("for update", _state(e, "SELECT * FROM region FOR UPDATE"))]
    e.sql("CREATE SCHEMA s; CREATE TABLE s.only_here (id INT); SET search_path TO s, public")
    out += [("search path", _state(e, "SELECT * FROM only_here")), ("unknown", _state(e, "UPDATE nothing SET a = 1")), ("limit", _state(e, "SELECT * FROM region LIMIT -1"))]
    return _told(spark, out, "what string, state string")


@_family.add("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000")
def session_prepared(spark, d):
    e = _engine(spark, d)
    e.attach("orders", f"{d}/orders.parquet")
    e.sql("PREPARE p AS SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = $1 AND o_totalprice > $2")
    return e.query("EXECUTE p(7, 1000)")


@_family.add("SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def session_parameters(spark, d):
    e = _engine(spark, d, "mysql")
    e.attach("orders", f"{d}/orders.parquet")
    return e.query("SELECT o_orderkey FROM orders WHERE o_custkey = ?", 7)


@_family.add("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 70, 'kept'")
def session_durable_catalog(spark, d):
    """What a new engine finds after the first one, with its only copy of the catalog, is gone."""
    folder = _folder(spark)
    e = Engine.open(spark, folder)
    e.adopt("region", table(spark, d, "region"), "r_regionkey")
    e.sql("CREATE VIEW names AS SELECT r_regionkey, r_name FROM region")
    e.sql("INSERT INTO region VALUES (70, 'kept')")
    del e
    return Engine.open(spark, folder).query("SELECT r_regionkey, r_name FROM names")


@_family.add("SELECT n_nationkey, upper(n_name) AS n_name, 1 AS files FROM nation")
def session_optimize_and_vacuum(spark, d):
    e = _engine(spark, d, "mysql", nation="n_nationkey")
    for r in range(3):
        e.sql(f"UPDATE nation SET n_name = upper(n_name) WHERE n_regionkey % 3 = {r}")
    e.sql("OPTIMIZE TABLE nation")
    files = len(e.table("nation").files)
    e.sql("VACUUM")
    return e.query("SELECT n_nationkey, n_name FROM nation").withColumn("files", F.lit(files))


# -- loads ---------------------------------------------------------------------

_HARD = r"concat(c_name, chr(9), 'a\b', chr(9), chr(92), 't', CASE WHEN c_custkey % 3 = 0 THEN chr(10) ELSE '' END)"


@_family.add(f"SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE {_HARD} END AS name FROM customer")
def copy_text(spark, d):
    hard = F.concat("c_name", F.lit("\ta\\b\t\\t"), F.when(F.expr("c_custkey % 3 = 0"), "\n").otherwise(""))
    escaped = hard
    for plain, code in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(code))
    line = F.concat_ws("\t", F.col("c_custkey").cast("string"), F.when(F.expr("c_custkey % 5 = 0"), "\\N").otherwise(escaped))
    folder = _folder(spark)
    table(spark, d, "customer").select(line.alias("value")).write.text(folder)
    e = _engine(spark, d)
    e.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, name TEXT)")
    e.sql(f"COPY t FROM '{folder}'")
    return e.query("SELECT id, name FROM t")


@_family.add("SELECT n_nationkey AS id, CASE WHEN n_regionkey > 0 THEN concat(n_name, chr(9), n_regionkey) END AS name FROM nation")
def copy_stdin(spark, d):
    """What a client sends piece by piece, with a header and an end mark."""
    few = table(spark, d, "nation").collect()  # 25 rows
    lines = (f"{r.n_nationkey}\t" + (f"{r.n_name}\\t{r.n_regionkey}" if r.n_regionkey > 0 else "\\N") + "\n" for r in few)
    e = _engine(spark, d)
    e.sql("CREATE TABLE t (id INT PRIMARY KEY, name TEXT)")
    e.sql("COPY t FROM STDIN WITH (HEADER true)", ("".join(x) for x in (["id\tname\n"], lines, ["\\.\n", "beyond the end"])))
    return e.query("SELECT id, name FROM t")


@_family.add("SELECT c_custkey AS id, concat(c_name, ', \"x\"', chr(10), 'y') AS name, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS segment FROM customer")
def copy_csv(spark, d):
    folder = _folder(spark)
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(',"'), "c_name", F.lit(', ""x""\ny",'), F.when(F.expr("c_custkey % 4 > 0"), F.col("c_mktsegment")).otherwise(""))
    table(spark, d, "customer").select(line.alias("value")).write.text(folder)
    e = _engine(spark, d)
    e.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, name TEXT, segment TEXT)")
    e.sql(f"COPY t (id, name, segment) FROM '{folder}' WITH (FORMAT csv, NULL '')")
    return e.query("SELECT id, name, segment FROM t")


@_family.add("SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part")
def load_data(spark, d):
    folder = _folder(spark)
    table(spark, d, "part").select(F.concat_ws("|", F.col("p_partkey").cast("string"), "p_name", F.col("p_size").cast("string")).alias("value")).write.text(folder)
    e = _engine(spark, d, "mysql")
    e.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, name TEXT, size INT)")
    e.sql(f"LOAD DATA LOCAL INFILE '{folder}' INTO TABLE t FIELDS TERMINATED BY '|'")
    return e.query("SELECT id, name, size FROM t")


@_family.add("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer")
def stream_ingest(spark, d):
    """A followed folder of delimited files, two files a batch; run a second time it adds nothing."""
    folder, checkpoint = _folder(spark), _folder(spark)
    table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("string")).repartition(5).write.csv(folder)
    e = _engine(spark, d)
    e.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, name TEXT, balance DOUBLE PRECISION)")
    for _ in range(2):
        ingest(e, "t", folder, checkpoint, max_files=2).awaitTermination()
    return e.query("SELECT id, name, balance FROM t")


@_family.add("SELECT 'json' AS format, n_nationkey, n_name FROM nation UNION ALL SELECT 'orc', n_nationkey, n_name FROM nation UNION ALL SELECT 'parquet', n_nationkey, n_name FROM nation")
def scan_file_formats(spark, d):
    out = None
    for kind in ("json", "orc", "parquet"):
        folder = _folder(spark)
        table(spark, d, "nation").write.format(kind).save(folder)
        rows = spark.read.format(kind).schema("n_nationkey int, n_name string").load(folder).select(F.lit(kind).alias("format"), "n_nationkey", "n_name")
        out = rows if out is None else out.union(rows)
    return out


@_family.add("SELECT l_partkey FROM lineitem WHERE l_partkey = 73 LIMIT 100")
def scan_filter_limit(spark, d):
    return table(spark, d, "lineitem").where("l_partkey = 73").limit(100).select("l_partkey")


# -- functions as SQL text -----------------------------------------------------


def _text(name: str, dialect: str, sql: str, oracle: str) -> None:
    """A query of one text over attached tables, run through the engine."""

    def query(spark, d):
        e = _engine(spark, d, dialect)
        for t in ("customer", "events", "lineitem", "nation", "orders", "part"):
            e.attach(t, f"{d}/{t}.parquet")
        return e.query(sql)

    query.__name__ = name
    _family.add(oracle)(query)


_text("text_strings", "mysql", """
    SELECT c_custkey, lower(c_name) AS a, upper(c_name) AS b, length(c_name) AS c, replace(c_name, '0', 'o') AS d, concat(c_name, '-', c_nationkey) AS e, concat_ws('/', c_name, NULL, c_mktsegment) AS f,
           substring(c_name FROM 2 FOR 3) AS g, trim(BOTH 'C' FROM c_name) AS h, substring_index(c_name, '#', 1) AS i, locate('0', c_name) AS j, instr(c_name, '#') AS k, elt(2, 'x', c_mktsegment) AS l, find_in_set('b', 'a,b,c') AS m FROM customer
""", """
    SELECT c_custkey, lower(c_name) AS a, upper(c_name) AS b, CAST(length(c_name) AS INT) AS c, replace(c_name, '0', 'o') AS d, concat(c_name, '-', c_nationkey) AS e, concat_ws('/', c_name, NULL, c_mktsegment) AS f,
           substring(c_name, 2, 3) AS g, trim(c_name, 'C') AS h, split_part(c_name, '#', 1) AS i, CAST(instr(c_name, '0') AS INT) AS j, CAST(instr(c_name, '#') AS INT) AS k, c_mktsegment AS l, 2 AS m FROM customer
""")  # fmt: skip
_text("text_numbers", "mysql", """
    SELECT o_orderkey, abs(-o_orderkey) AS a, o_custkey DIV 7 AS b, o_custkey % 7 AS c, round(o_totalprice) AS d, o_totalprice / 4 AS e, +o_custkey AS f, -o_custkey AS g, o_custkey & 6 AS h, o_custkey | 1 AS i, greatest(o_custkey, 50) AS j, least(o_custkey, 50) AS k FROM orders
""", """
    SELECT o_orderkey, abs(-o_orderkey) AS a, o_custkey // 7 AS b, o_custkey % 7 AS c, round(o_totalprice) AS d, o_totalprice / 4 AS e, o_custkey AS f, -o_custkey AS g, o_custkey & 6 AS h, o_custkey | 1 AS i, greatest(o_custkey, 50) AS j, least(o_custkey, 50) AS k FROM orders
""")  # fmt: skip
_text("text_dates", "mysql", """
    SELECT event_id, date_format(ts, '%Y-%m-%d') AS a, date_format(date_add(ts, INTERVAL 3 DAY), '%Y/%m/%d %H:%i') AS b, timestampdiff(DAY, '2020-01-01 00:00:00', ts) AS c, date_format(last_day(ts), '%d') AS d, from_unixtime(86400) AS e FROM events
""", """
    SELECT event_id, strftime(ts, '%Y-%m-%d') AS a, strftime(ts + INTERVAL 3 DAY, '%Y/%m/%d %H:%M') AS b, CAST(floor(epoch(ts - TIMESTAMP '2020-01-01') / 86400) AS BIGINT) AS c, strftime(last_day(ts), '%d') AS d, '1970-01-02 00:00:00' AS e FROM events
""")  # fmt: skip
_text("text_json", "mysql", """
    SELECT event_id, json_extract(props, '$.k') AS a, props -> '$.k' AS b, props ->> '$.k' AS c, json_unquote('"q"') AS d, json_contains(props, '{"k": 7}') AS e FROM events
""", "SELECT event_id, props ->> '$.k' AS a, props ->> '$.k' AS b, props ->> '$.k' AS c, 'q' AS d, (props ->> '$.k') = '7' AS e FROM events")  # fmt: skip
_text("text_aggregates", "mysql", """
    SELECT n_regionkey, group_concat(n_name ORDER BY n_name SEPARATOR ';') AS a, any_value(n_regionkey) AS b, json_arrayagg(n_regionkey) AS c, json_objectagg('r', n_regionkey) AS d FROM (SELECT * FROM nation) AS t GROUP BY n_regionkey
""", """
    SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS a, any_value(n_regionkey) AS b, concat('[', string_agg(CAST(n_regionkey AS VARCHAR), ','), ']') AS c, concat('{"r":', any_value(n_regionkey), '}') AS d FROM nation GROUP BY n_regionkey
""")  # fmt: skip
_text("text_session_values", "mysql", """
    SELECT n_nationkey, charset(n_name) AS a, collation(n_name) AS b, user() AS c, session_user() AS d, current_user() AS e, connection_id() AS f, row_count() AS g, last_insert_id() AS h, database() AS i, @@tx_isolation AS j, curdate() = current_date() AS k, length(curtime()) AS l, now() IS NOT NULL AS m FROM nation
""", """
    SELECT n_nationkey, 'utf8mb4' AS a, 'utf8mb4_bin' AS b, 'root' AS c, 'root' AS d, 'root' AS e, CAST(0 AS BIGINT) AS f, CAST(0 AS BIGINT) AS g, CAST(0 AS BIGINT) AS h, 'defaultdb' AS i, 'READ-COMMITTED' AS j, TRUE AS k, 8 AS l, TRUE AS m FROM nation
""")  # fmt: skip
_text("text_postgres", "postgres", """
    SELECT n_nationkey, n_name COLLATE "C" AS a, coalesce(NULLIF(n_name, 'CHINA'), 'none') AS b, n_name LIKE 'C%' AS c, n_regionkey = ANY(ARRAY[1, 2]) AS d, strpos(n_name, 'A') AS e, array_to_string(ARRAY['a', 'b'], '-') AS f, CASE WHEN n_regionkey IS DISTINCT FROM 1 THEN 1 ELSE 0 END AS g FROM nation
""", """
    SELECT n_nationkey, n_name AS a, coalesce(NULLIF(n_name, 'CHINA'), 'none') AS b, n_name LIKE 'C%' AS c, n_regionkey IN (1, 2) AS d, CAST(instr(n_name, 'A') AS INT) AS e, 'a-b' AS f, CASE WHEN n_regionkey <> 1 THEN 1 ELSE 0 END AS g FROM nation
""")  # fmt: skip

#: The queries of functions and JSON again as SQL text: what they give as Columns, the engine gives for text.
_SAME = {
    "fn_lower_upper_length": "SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, CAST(length(c_name) AS BIGINT) AS n FROM customer",
    "fn_substring_trim": "SELECT p_partkey, substring(p_name, -2, 4) AS a, substring(p_name FROM 3 FOR 5) AS b, trim(concat('  ', p_brand, ' ')) AS t, trim(BOTH 'B' FROM p_brand) AS x FROM part",
    "fn_replace": "SELECT p_partkey, replace(p_type, 'E', '-e-') AS r FROM part",
    "fn_concat_nullskip": "SELECT c_custkey, concat(c_name, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE '-' END, c_nationkey) AS r FROM customer",
    "fn_concat_ws": "SELECT c_custkey, concat_ws('/', c_name, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'odd' END, c_mktsegment) AS r FROM customer",
    "fn_substring_index": "SELECT p_partkey, substring_index(p_type, ' ', 2) AS a, substring_index(p_type, ' ', -1) AS b FROM part",
    "fn_locate_instr": "SELECT p_partkey, CAST(instr(p_name, 'e') AS BIGINT) AS a, CAST(locate('e', p_name, 4) AS BIGINT) AS b FROM part",
    "fn_field_elt": "SELECT c_custkey, CAST(field(c_mktsegment, 'BUILDING', 'MACHINERY') AS BIGINT) AS f, elt(c_nationkey, 'one', 'two', 'three') AS e FROM customer",
    "fn_find_in_set": "SELECT c_custkey, CAST(find_in_set(c_mktsegment, 'AUTOMOBILE,BUILDING') AS BIGINT) AS p FROM customer",
    "fn_format": "SELECT p_partkey, format(p_retailprice, 3) AS f FROM part",
    "fn_regexp_replace": "SELECT p_partkey, regexp_replace(p_name, 'a', 'o') AS r, p_name REGEXP '^.*e' AS m FROM part",
    "fn_library_strings": "SELECT p_partkey, left(p_name, 3) AS a, right(p_name, 2) AS b, reverse(p_name) AS c, lpad(p_name, 20, '*') AS d, repeat('x', p_size) AS e, md5(p_name) AS f, split_part(p_type, ' ', 2) AS g FROM part",
    "fn_date_trunc": "SELECT event_id, CAST(date_trunc('year', ts) AS DATETIME) AS y, CAST(date_trunc('month', ts) AS DATETIME) AS m, CAST(date_trunc('hour', ts) AS DATETIME) AS h FROM events",
    "fn_extract": "SELECT event_id, " + ", ".join(f"CAST(extract({u} FROM ts) AS BIGINT) AS {n}" for u, n in (("year", "y"), ("month", "m"), ("day", "dd"), ("hour", "h"), ("minute", "mi"), ("second", "s"))) + " FROM events",
    "fn_date_add_sub": "SELECT o_orderkey, date_add(o_orderdate, INTERVAL 1 MONTH) AS m, date_sub(o_orderdate, INTERVAL 10 DAY) AS dd, date_add(o_orderdate, INTERVAL 2 WEEK) AS w FROM orders",
    "fn_timestampadd": "SELECT o_orderkey, timestampadd(HOUR, 3, o_orderdate) AS h, date_add(o_orderdate, INTERVAL 2 YEAR) AS y FROM orders",
    "fn_timestampdiff": "SELECT l_orderkey, l_linenumber, timestampdiff(MONTH, o_orderdate, l_shipdate) AS m, timestampdiff(DAY, o_orderdate, l_shipdate) AS dd, timestampdiff(WEEK, o_orderdate, l_shipdate) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate",
    "fn_date_format": "SELECT event_id, date_format(ts, '%Y/%m/%d %H-%i-%s') AS f FROM events",
    "fn_str_to_date": "SELECT event_id, str_to_date(date_format(ts, '%d.%m.%Y %H:%i:%s'), '%d.%m.%Y %H:%i:%s') AS back FROM events",
    "fn_unix_timestamp": "SELECT event_id, unix_timestamp(ts) AS u FROM events",
    "fn_from_unixtime": "SELECT event_id, from_unixtime((event_id - 50) * 86399) AS t FROM events",
    "fn_last_day": "SELECT o_orderkey, last_day(o_orderdate) AS l FROM orders",
    "fn_week": "SELECT o_orderkey, CAST(week(o_orderdate) AS BIGINT) AS w FROM orders",
    "fn_abs_round_ceil_floor": "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal) AS r, ceil(c_acctbal) AS c, floor(c_acctbal) AS f FROM customer",
    "fn_int_division": "SELECT o_orderkey, o_orderkey DIV 7 AS q, -o_custkey DIV 4 AS z, o_custkey DIV -4 AS y FROM orders",
    "fn_mod_div": "SELECT o_orderkey, (0 - o_orderkey) % 7 AS m, o_orderkey % (-5) AS k FROM orders",
    "fn_bitops": "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS b, o_orderkey ^ 255 AS c, ~o_orderkey AS n FROM orders",
    "fn_coalesce_nullif": "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS a, nullif(c_mktsegment, 'BUILDING') AS b FROM customer",
    "fn_greatest_least": "SELECT c_custkey, greatest(c_nationkey, 7, NULL) AS g, least(c_nationkey, 7, NULL) AS l FROM customer",
    "fn_truthiness": "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 AND NOT (o_custkey % 2)",
    "fn_library_maths": "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS s, round(power(p_size, 2), 2) AS p, round(ln(p_retailprice), 6) AS l, round(sin(p_size), 6) AS t, CAST(sign(p_size - 20) AS INT) AS g FROM part",
    "json_arrow": "SELECT event_id, props -> '$.k' AS k FROM events",
    "json_arrow_text": "SELECT event_id, props ->> '$.k' AS k, CAST(props ->> '$.k' AS INT) + 1 AS k1 FROM events",
    "json_extract_multi": "SELECT event_id, json_extract(props, '$.k', '$.missing', '$.k') AS both FROM events",
    "json_contains": "SELECT event_id FROM events WHERE json_contains(props, '{\"k\": 7}')",
    "json_set_replace_remove": "SELECT event_id, json_set(props, '$.n', event_id) AS s, json_replace(props, '$.k', event_type) AS r, json_remove(props, '$.k') AS x FROM events",
    "json_object_array": "SELECT event_id, json_object('id', event_id, 't', event_type) AS o, json_array(event_id, event_type, NULL) AS a FROM events",
    "json_unquote": "SELECT event_id, json_unquote(concat('\"', event_type, '\"')) AS u FROM events",
}
for _name, _sql in _SAME.items():
    _text(f"text_{_name}", "mysql", _sql, scalars.ORACLE_SQL[_name])
_text("text_json_has_key", "postgres", "SELECT event_id, props ? 'k' AS a, props ? 'z' AS b FROM events", scalars.ORACLE_SQL["json_has_key"])


# -- catalogs ------------------------------------------------------------------


@_family.add("SELECT * FROM (VALUES ('pg_am', 2), ('pg_cast', 8), ('pg_proc', 20), ('pg_roles', 1), ('pg_sequence', 0), ('pg_shdescription', 0), ('pg_tables', 1), ('pg_trigger', 0), ('pg_user', 1), ('pg_views', 1), ('pg_indexes', 1), ('pg_database', 1)) AS v(relation, n)")
def cat_pg_counts(spark, d):
    e = _catalogued(spark, d)
    names = "pg_am pg_cast pg_proc pg_roles pg_sequence pg_shdescription pg_tables pg_trigger pg_user pg_views pg_indexes pg_database".split()
    return e.query(" UNION ALL ".join(f"SELECT '{n}' AS relation, CAST(count(*) AS INT) AS n FROM pg_catalog.{n}" for n in names))


def _catalogued(spark, d, dialect="postgres"):
    e = _engine(spark, d, dialect, region="r_regionkey")
    e.sql("CREATE SEQUENCE s; CREATE VIEW v AS SELECT r_name FROM region")
    return e


@_family.add("SELECT * FROM (VALUES ('public', 'region', 'BASE TABLE'), ('public', 'v', 'VIEW')) AS v(table_schema, table_name, table_type)")
def cat_information_schema_tables(spark, d):
    return _catalogued(spark, d).query("SELECT table_schema, table_name, table_type FROM information_schema.tables WHERE table_schema = 'public'")


@_family.add("SELECT 'v' AS viewname, 'SELECT r_name FROM region' AS by_name, 'SELECT r_name FROM region' AS by_number, 'integer' AS kind")
def cat_view_definition(spark, d):
    e = _catalogued(spark, d)
    return e.query("SELECT relname AS viewname, pg_get_viewdef('v') AS by_name, pg_get_viewdef(oid) AS by_number, to_regtype('integer') AS kind FROM pg_catalog.pg_class WHERE relkind = 'v'")


@_family.add("SELECT * FROM (VALUES ('engines', 1), ('character_sets', 1), ('collations', 1), ('schemata', 1)) AS v(relation, n)")
def cat_mysql_information_schema(spark, d):
    e = _catalogued(spark, d, "mysql")
    counts = [f"SELECT '{n}' AS relation, CAST(count(*) AS INT) AS n FROM information_schema.{n}" for n in ("engines", "character_sets", "collations")]
    return e.query(" UNION ALL ".join([*counts, "SELECT 'schemata', CAST(least(1, count(*)) AS INT) FROM information_schema.schemata"]))


@_family.add("SELECT 'region' AS name")
def cat_show_tables(spark, d):
    return _engine(spark, d, "mysql", region="r_regionkey").query("SHOW TABLES").toDF("name")


@_family.add("SELECT 'UTF8' AS value")
def cat_show_setting(spark, d):
    return _engine(spark, d).query("SHOW client_encoding").toDF("value")
