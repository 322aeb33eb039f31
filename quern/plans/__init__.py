"""Named queries over the driver's tables and the SQL they must agree with."""

from quern.plans import aggregates, joins, predicates, scalars, scans, sessions, statements, subqueries, topn, windows

QUERIES = {}
ORACLE_SQL = {}
for _module in (scans, predicates, topn, aggregates, joins, subqueries, windows, scalars, statements, sessions):
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
