"""A PySpark-native analytics engine: SQL dialect front end, typed catalog, DML and query library."""
