"""What the engine knows about tables, and how their rows are kept.

A table is a set of immutable Parquet files; a change makes a new Table value
that names other files. So a snapshot is a mapping of names to Table values,
and a transaction, a savepoint or a reader just holds on to one. Columns are
stored under their number, which makes RENAME, DROP and ADD COLUMN changes of
metadata alone.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import SqlError
from quern.types import LogicalType, parse_type

#: Marks rows that a statement inserted or changed, in the files it wrote.
HIT = "quern_hit"
#: The place of a new row among those of its statement.
ORDER = "quern_order"


@dataclass(frozen=True)
class Column:
    number: int
    name: str
    type: LogicalType
    nullable: bool = True
    default: str | None = None
    on_update: str | None = None
    auto: bool = False

    @property
    def stored(self) -> str:
        return f"c{self.number}"


@dataclass(frozen=True)
class ForeignKey:
    name: str
    columns: tuple[str, ...]
    table: str
    references: tuple[str, ...]


@dataclass(frozen=True)
class Index:
    name: str
    columns: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class Table:
    schema: str
    name: str
    columns: tuple[Column, ...]
    primary_key: str | None = None
    checks: tuple[tuple[str, str], ...] = ()
    uniques: tuple[tuple[str, tuple[str, ...]], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    indexes: tuple[Index, ...] = ()
    files: tuple[str, ...] = ()
    version: int = 0
    statistics: tuple[dict, ...] = ()
    row_count: int | None = None

    @property
    def key(self) -> str:
        return f"{self.schema}.{self.name}"

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise SqlError("42703", f"column {name} of {self.name} does not exist")

    def has(self, name: str) -> bool:
        return any(c.name.lower() == name.lower() for c in self.columns)

    def next_number(self) -> int:
        return max([0, *(c.number for c in self.columns)]) + 1

    def unique_keys(self) -> list[tuple[str, tuple[str, ...]]]:
        """The primary key first, then UNIQUE constraints, then unique indexes."""
        keys = [(f"{self.name}_pkey", (self.primary_key,))] if self.primary_key else []
        return keys + list(self.uniques) + [(i.name, i.columns) for i in self.indexes if i.unique]

    def read(self, spark: SparkSession, files: tuple[str, ...] | None = None, *extra: str) -> DataFrame:
        """Rows of the table, or of some of its files; extra: HIT, ORDER, or `file` and `place`, the file of each row and its number there."""
        files = self.files if files is None else files
        fields = [T.StructField(c.stored, c.type.spark) for c in self.columns] + [T.StructField(HIT, T.BooleanType())] * (HIT in extra) + [T.StructField(ORDER, T.LongType())] * (ORDER in extra)
        if not files:
            out = spark.createDataFrame([], T.StructType(fields + [T.StructField("file", T.StringType())] * ("file" in extra) + [T.StructField("place", T.LongType())] * ("place" in extra)))
        else:
            out = spark.read.schema(T.StructType(fields)).parquet(*files)
            if "file" in extra:
                out = out.withColumns({"file": F.col("_metadata.file_path"), "place": F.col("_metadata.row_index")})
        return out.select(*(F.col(c.stored).alias(c.name) for c in self.columns), *extra)


class Store:
    """Writes rows as new files of a table. Each write has a folder of its own, named unlike any other.

    written: the folders that sessions with the same catalog have written. recent: those of the running statement, whose
    files may not be a table's yet.
    """

    def __init__(self, spark: SparkSession, folder: str, written: set[str] | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.written = set() if written is None else written
        self.recent: list[str] = []

    def write(self, table: Table, rows: DataFrame) -> tuple[str, ...]:
        """rows must have the table's columns by name, and may have HIT and ORDER."""
        path = self._fresh(f"{table.schema}.{table.name}")
        extra = [x for x in (HIT, ORDER) if x in rows.columns]
        rows.select(*(F.col(f"`{c.name}`").cast(c.type.spark).alias(c.stored) for c in table.columns), *extra).write.parquet(path)
        return tuple(sorted(self.spark.read.parquet(path).inputFiles()))

    def _fresh(self, name: str) -> str:
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        self.recent.append(path)
        self.written.add(path)
        return path

    def numbered(self, rows: DataFrame, missing: SparkColumn, name: str, take) -> DataFrame:
        """rows with a number in column `name` where missing says so; take(n) gives the first of n numbers and their step.

        The rows are written first. Numbers then follow from the files and the rows' places in them, so they are the same
        whenever a task runs again. Only a count for each file comes to the driver.
        """
        path = self._fresh("quern_staged")
        rows.withColumn(name, missing).write.parquet(path)
        staged = self.spark.read.parquet(path).withColumns({"quern_file": F.col("_metadata.file_path"), "quern_place": F.col("_metadata.row_index")})
        counts = sorted(map(tuple, staged.where(F.col(name)).groupBy("quern_file").agg(F.count(F.lit(1))).collect()))
        total = sum(n for _, n in counts)
        if not total:
            return staged.drop("quern_file", "quern_place", name).withColumn(name, F.lit(None).cast("long"))
        first, step = take(total)
        before, starts = 0, []
        for file, n in counts:
            starts.append((file, before))
            before += n
        offsets = self.spark.createDataFrame(starts, "quern_file string, quern_before long")
        within = F.count_if(F.col(name)).over(Window.partitionBy("quern_file").orderBy("quern_place").rowsBetween(Window.unboundedPreceding, 0))
        placed = staged.withColumn("quern_within", within).join(F.broadcast(offsets), "quern_file", "left")
        value = F.when(F.col(name), F.lit(first) + (F.col("quern_before") + F.col("quern_within") - 1) * step)
        return placed.withColumn(name, value.cast("long")).drop("quern_file", "quern_place", "quern_within", "quern_before")

    # -- files -------------------------------------------------------------

    def _place(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def bytes(self, files: tuple[str, ...]) -> int:
        return sum(fs.getFileStatus(p).getLen() for fs, p in map(self._place, files))

    def remove_unused(self, written: set[str], used: set[str]) -> None:
        """Delete those of the written folders that hold no used file.

        Folders are known by their last names: the same place may be spelt with or without its file system.
        """
        held = {f.rsplit("/", 2)[-2] for f in used}
        for path in written:
            if path.rsplit("/", 1)[-1] not in held:
                fs, place = self._place(path)
                fs.delete(place, True)
                self.written.discard(path)

    def published(self) -> set[str]:
        """The folders still there of which any published catalog, also an older one, names a file."""
        fs, top = self._place(self.folder)
        there = {}
        for table in fs.listStatus(top) if fs.exists(top) else []:
            if table.isDirectory() and not table.getPath().getName().startswith("_"):
                there |= {w.getPath().getName(): w.getPath().toString() for w in fs.listStatus(table.getPath())}
        if not there:
            return set()
        named = self.spark.read.text(f"{self.folder}/_catalog/*.json", wholetext=True)
        folders = named.select(F.explode(F.from_json("value", "tables map<string, struct<files: array<string>>>")["tables"]).alias("k", "t")).select(F.explode("t.files").alias("file"))
        folders = folders.select(F.element_at(F.split("file", "/"), -2).alias("name")).distinct()
        listed = self.spark.createDataFrame([(n,) for n in there], "name string")
        return {there[r[0]] for r in folders.join(listed, "name").collect()}

    # -- the catalog beside the files --------------------------------------

    def manifest(self) -> tuple[int, dict | None]:
        """The number and content of the last published catalog; 0 and None if there is none."""
        fs, folder = self._place(f"{self.folder}/_catalog")
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        numbers = [int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n)]
        if not numbers:
            return 0, None
        lines = self.spark.sparkContext.wholeTextFiles(f"{self.folder}/_catalog/{max(numbers):012d}.json").collect()
        return max(numbers), json.loads(lines[0][1])

    def publish(self, number: int, content: dict) -> None:
        """Make content the catalog of this number. Fails if another session published that number first."""
        part = f"{self.folder}/_catalog/{uuid.uuid4().hex}.part"
        fs, place = self._place(part)
        out = fs.create(place, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        goal = self._place(f"{self.folder}/_catalog/{number:012d}.json")[1]
        if fs.exists(goal) or not fs.rename(place, goal):
            fs.delete(place, False)
            raise SqlError("40001", "could not serialize access: another session changed the catalog")


class Sequence:
    """A counter that is not part of any transaction."""

    def __init__(self, start: int = 1, step: int = 1):
        self.start, self.next, self.step = start, start, step

    def take(self, n: int = 1) -> int:
        """The first of n values."""
        first = self.next
        if first + n * self.step > 2**63 - 1:
            raise SqlError("2200H", "the sequence has reached its limit")
        self.next = first + n * self.step
        return first

    def raise_to(self, used: int) -> None:
        """After an explicit value: go on behind it if it is larger."""
        self.next = max(self.next, used + self.step)


def with_table(tables: dict[str, Table], table: Table) -> dict[str, Table]:
    """A snapshot in which this table has its next version."""
    return tables | {table.key: replace(table, version=table.version + 1)}


def to_json(table: Table) -> dict:
    """A table as plain values; types by how they would be declared."""
    out = asdict(replace(table, columns=()))
    out["columns"] = [asdict(replace(c, type=None)) | {"type": c.type.sql()} for c in table.columns]
    return out


def from_json(x: dict) -> Table:
    tuples = lambda rows: tuple((name, tuple(v) if isinstance(v, list) else v) for name, v in rows)
    parts = {
        "columns": tuple(Column(**c | {"type": parse_type(c["type"])}) for c in x["columns"]),
        "checks": tuples(x["checks"]),
        "uniques": tuples(x["uniques"]),
        "foreign_keys": tuple(ForeignKey(f["name"], tuple(f["columns"]), f["table"], tuple(f["references"])) for f in x["foreign_keys"]),
        "indexes": tuple(Index(i["name"], tuple(i["columns"]), i["unique"]) for i in x["indexes"]),
        "files": tuple(x["files"]),
        "statistics": tuple(x["statistics"]),
    }
    return Table(**x | parts)
