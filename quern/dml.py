"""Changes of rows: copy-on-write by file, with constraints checked before anything becomes visible.

Only files that hold rows to be changed are rewritten; all others are kept by
name. Every statement first writes its new files, then checks constraints on
them with distributed queries, and only then returns the table's next value.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.catalog import HIT, ORDER, Store, Table
from quern.errors import SqlError


def _keyed(table: Table, key: tuple[str, ...], left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join by a key's columns; rows with a NULL in the key match nothing."""
    l, r = left.alias("l"), right.alias("r")  # noqa: E741
    on = F.lit(True)
    for c in key:
        on = on & (F.col(f"l.`{c}`") == F.col(f"r.`{c}`"))
    return l.join(r, on, how)


def check(spark: SparkSession, table: Table, fresh: DataFrame, others: DataFrame, tables: dict[str, Table]) -> None:
    """Raise if new rows break a constraint. others: the table's rows that stay beside them."""
    rules = [(c.name, "23502", F.col(f"`{c.name}`").isNull(), f"null value in column {c.name}") for c in table.columns if not c.nullable]
    rules += [(name, "23514", ~F.coalesce(F.expr(sql), F.lit(True)), f"new row violates check constraint {name}") for name, sql in table.checks]
    if rules:
        found = fresh.agg(*(F.max(F.when(bad, 1)).alias(f"r{i}") for i, (_, _, bad, _) in enumerate(rules))).first()
        for i, (_, state, _, said) in enumerate(rules):
            if found[f"r{i}"]:
                raise SqlError(state, said)
    for fk in table.foreign_keys:
        there = tables.get(fk.table)
        if there is None:
            raise SqlError("42P01", f"relation {fk.table} does not exist")
        known = (fresh if there.key == table.key else there.read(spark)).select(*(F.col(f"`{r}`").alias(c) for c, r in zip(fk.columns, fk.references, strict=True)))
        if there.key == table.key:
            known = known.union(others.select(*(F.col(f"`{r}`") for r in fk.references)))
        have = fresh.where(_all_set(fk.columns))
        if not _keyed(table, fk.columns, have, known, "left_anti").isEmpty():
            raise SqlError("23503", f"insert or update violates foreign key constraint {fk.name}")
    for name, key in table.unique_keys():
        have = fresh.where(_all_set(key)).select(*(f"`{c}`" for c in key))
        twice = have.groupBy(*(f"`{c}`" for c in key)).agg(F.count(F.lit(1)).alias("quern_n")).where("quern_n > 1")
        if not twice.isEmpty() or not _keyed(table, key, have, others, "left_semi").isEmpty():
            raise SqlError("23505", f"duplicate key value violates unique constraint {name}")


def check_removed(spark: SparkSession, table: Table, gone: DataFrame, tables: dict[str, Table]) -> None:
    """Raise if rows of another table refer to rows that go."""
    for other in tables.values():
        for fk in other.foreign_keys:
            if fk.table == table.key:
                lost = gone.select(*(F.col(f"`{r}`").alias(c) for c, r in zip(fk.columns, fk.references, strict=True)))
                if not _keyed(other, fk.columns, other.read(spark), lost, "left_semi").isEmpty():
                    raise SqlError("23503", f"update or delete violates foreign key constraint {fk.name} on {other.name}")


def _all_set(columns: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"`{c}`").isNotNull()
    return out


class Change:
    """What a statement did: the table's next value, the rows to return, and counts."""

    def __init__(self, table: Table, rows: DataFrame | None, affected: int):
        self.table, self.rows, self.affected = table, rows, affected


def insert(store: Store, table: Table, rows: DataFrame, tables: dict[str, Table]) -> Change:
    """Append rows."""
    files = store.write(table, rows.withColumn(HIT, F.lit(True)))
    fresh = table.read(store.spark, files)
    check(store.spark, table, fresh, table.read(store.spark), tables)
    return Change(replace(table, files=table.files + files), fresh, fresh.count())


def upsert(
    store: Store, table: Table, rows: DataFrame, tables: dict[str, Table], keys: list[tuple[str, ...]], assign: dict[str, Column] | None, where: Column | None = None, replace_all: bool = False, mysql: bool = False
) -> Change:
    """Insert rows, or act on those that have a key already.

    assign None: leave them (of new rows with one key the first stays). replace_all: put the new row in
    the old one's place (the last stays). Else set columns of the old row: expressions over `old.c` and
    `new.c`; two new rows for one old row are an error. Keys are tried in order.
    """
    spark = store.spark
    # a number for each new row, in their order, so that first and last mean something
    staged = store.write(table, rows.withColumn(ORDER, F.monotonically_increasing_id()))
    numbered = table.read(spark, staged, ORDER)
    for key in keys:
        if assign is None or replace_all:
            pick = F.max_by if replace_all else F.min_by
            kept = numbered.where(_all_set(key)).groupBy(*(f"`{c}`" for c in key)).agg(pick(F.struct(*(f"`{c}`" for c in numbered.columns)), ORDER).alias("q")).select("q.*")
            numbered = kept.unionByName(numbered.where(~_all_set(key)))
        elif not numbered.where(_all_set(key)).groupBy(*(f"`{c}`" for c in key)).agg(F.count(F.lit(1)).alias("quern_n")).where("quern_n > 1").isEmpty():
            raise SqlError("21000", "the statement can't affect a row a second time")
    old = table.read(spark, None, "file", "place")
    names = [c.name for c in table.columns]
    hits = None
    fresh = numbered
    for key in keys:
        pair = _keyed(table, key, old, numbered if replace_all else fresh, "inner").select(F.struct("l.*").alias("o"), F.struct("r.*").alias("n"))
        hits = pair if hits is None else hits.union(pair)
        fresh = _keyed(table, key, fresh, old, "left_anti").select("l.*")
    if hits is None:  # a table without any key
        return insert(store, table, rows, tables)
    hits = hits.dropDuplicates(["n"]) if len(keys) > 1 and not replace_all else hits
    fresh = fresh.select(*(f"`{n}`" for n in names)).withColumn(HIT, F.lit(True))
    if assign is None and not replace_all:
        files = store.write(table, fresh)
        made = table.read(spark, files)
        check(spark, table, made, old.drop("file", "place"), tables)
        return Change(replace(table, files=table.files + files), made, made.count())

    touched = tuple(r[0] for r in hits.select("o.file").distinct().collect())
    kept_files = tuple(f for f in table.files if f not in _same(table.files, touched))
    cols = lambda side: [F.col(f"{side}.`{n}`") for n in names]
    if replace_all:
        changed = hits.select(*(F.col(f"n.`{n}`").alias(n) for n in names)).distinct().withColumn(HIT, F.lit(True))
        same = F.lit(False)
    else:
        p = hits.select(F.col("o").alias("old"), F.col("n").alias("new"))
        can = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        new_values = {n: F.when(can, assign[n]).otherwise(F.col(f"old.`{n}`")) if n in assign else F.col(f"old.`{n}`") for n in names}
        p = p.select(*(v.cast(table.column(n).type.spark).alias(n) for n, v in new_values.items()), F.struct(*cols("old")).alias("quern_old"), can.alias(HIT))
        changed = p
        same = F.struct(*(F.col(f"`{n}`") for n in names)).eqNullSafe(F.struct(*(F.col(f"quern_old.`{n}`").alias(n) for n in names)))
    gone = hits.select(*(F.col(f"o.`{n}`").alias(n) for n in names)).distinct()
    rest = table.read(spark, _same(table.files, touched), "file", "place")
    places = hits.select(F.col("o.file").alias("file"), F.col("o.place").alias("place")).distinct()
    stay = rest.join(places, ["file", "place"], "left_anti").select(*(f"`{n}`" for n in names)).withColumn(HIT, F.lit(False))
    untouched = changed.count(), (changed.where(F.col(HIT) & same).count() if mysql and not replace_all else 0)
    out = stay.unionByName(changed.select(*(f"`{n}`" for n in names), HIT)).unionByName(fresh)
    files = store.write(table, out)
    made = table.read(spark, files, HIT)
    check(spark, table, made.drop(HIT), table.read(spark, kept_files), tables)
    inserted = fresh.count()
    updated = made.where(HIT).count() - inserted
    affected = inserted + (2 * (updated - untouched[1]) if mysql else updated)
    if replace_all:
        affected = inserted + updated + gone.count()
    return Change(replace(table, files=kept_files + files), made.where(HIT).drop(HIT), affected)


def _same(files: tuple[str, ...], touched: tuple[str, ...]) -> tuple[str, ...]:
    """The table's names of files that Spark may spell with other slashes."""
    plain = {"/" + t.split(":", 1)[-1].lstrip("/") for t in touched}
    return tuple(f for f in files if "/" + f.split(":", 1)[-1].lstrip("/") in plain)


def _limited(table: Table, rows: DataFrame, limit: int | None, descending: bool) -> DataFrame:
    if limit is None:
        return rows
    if table.primary_key is None:
        raise SqlError("0A000", "a limited change needs a primary key")
    key = F.col(f"`{table.primary_key}`")
    return rows.orderBy(key.desc() if descending else key.asc()).limit(limit)


def update(store: Store, table: Table, assign: dict[str, Column], where: Column | None, tables: dict[str, Table], limit: int | None = None, descending: bool = False, mysql: bool = False) -> Change:
    """Set columns of the rows that fit; all expressions see the old row."""
    spark = store.spark
    for c in table.columns:
        if c.on_update and c.name not in assign:
            assign[c.name] = F.expr(c.on_update)
    fits = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    hits = _limited(table, table.read(spark, None, "file").where(fits), limit, descending)
    touched = tuple(r[0] for r in hits.select("file").distinct().collect())
    files = _same(table.files, touched)
    if not files:
        return Change(table, table.read(spark, ()), 0)
    rows = table.read(spark, files)
    if limit is not None:
        pick = hits.select(F.col(f"`{table.primary_key}`").alias("quern_key"))
        rows = rows.join(pick, F.col(f"`{table.primary_key}`") == F.col("quern_key"), "left").withColumn("quern_fits", F.col("quern_key").isNotNull())
    else:
        rows = rows.withColumn("quern_fits", fits)
    values = {c.name: c.type.checked(assign[c.name], c.name) if c.name in assign else None for c in table.columns}
    new = [F.when(F.col("quern_fits"), v).otherwise(F.col(f"`{n}`")).alias(n) if v is not None else F.col(f"`{n}`") for n, v in values.items()]
    changed = F.col("quern_fits")
    if mysql:
        differs = F.lit(False)
        for n, v in values.items():
            if v is not None:
                differs = differs | ~F.col(f"`{n}`").eqNullSafe(v)
        made_count = rows.where(F.col("quern_fits") & differs).count()
    out = rows.select(*new, changed.alias(HIT))
    written = store.write(table, out)
    made = table.read(spark, written, HIT)
    kept = tuple(f for f in table.files if f not in files)
    others = table.read(spark, kept).unionByName(made.where(f"NOT {HIT}").drop(HIT))
    fresh = made.where(HIT).drop(HIT)
    check(spark, table, fresh, others, tables)
    referred = {r for o in tables.values() for fk in o.foreign_keys if fk.table == table.key for r in fk.references} & set(assign)
    if referred:
        was = hits.drop("file")
        for r in referred:
            check_removed(spark, table, was.join(fresh.select(F.col(f"`{r}`").alias("quern_new")), F.col(f"`{r}`") == F.col("quern_new"), "left_anti"), tables)
    return Change(replace(table, files=kept + written), fresh, made_count if mysql else fresh.count())


def delete(store: Store, table: Table, where: Column | None, tables: dict[str, Table], limit: int | None = None, descending: bool = False) -> Change:
    """Remove the rows that fit."""
    spark = store.spark
    fits = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    hits = _limited(table, table.read(spark, None, "file").where(fits), limit, descending)
    counts = {r[0]: r[1] for r in hits.groupBy("file").agg(F.count(F.lit(1))).collect()}
    files = _same(table.files, tuple(counts))
    gone = hits.drop("file")
    check_removed(spark, table, gone, tables)
    if not files:
        return Change(table, gone, 0)
    rows = table.read(spark, files)
    if limit is not None:
        pick = gone.select(F.col(f"`{table.primary_key}`").alias("quern_key"))
        rest = rows.join(pick, F.col(f"`{table.primary_key}`") == F.col("quern_key"), "left_anti")
    else:
        rest = rows.where(~fits)
    written = store.write(table, rest)
    kept = tuple(f for f in table.files if f not in files)
    return Change(replace(table, files=kept + written), gone, sum(counts.values()))
