"""Chunked ingestion: new delimited files become rows of a table, a micro-batch at a time."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quern import dml

if TYPE_CHECKING:
    from quern.engine import Engine


def ingest(engine: Engine, name: str, folder: str, checkpoint: str, *, delimiter: str = ",", null: str = "", max_files: int = 100, available_now: bool = True) -> StreamingQuery:
    """Follow a folder of headerless csv files.

    Each batch passes all checks of an insert and becomes visible as a whole.
    With available_now the query ends when all files present are in. A batch
    that is repeated after a failure would break the primary key and so is
    skipped by key where the table has one.
    """
    table = engine.table(name)
    names = [c.name for c in table.columns]
    stream = engine.spark.readStream.schema(", ".join(f"v{i} string" for i in range(len(names)))).option("sep", delimiter).option("nullValue", null).option("maxFilesPerTrigger", max_files).csv(folder)

    def add(batch: DataFrame, _: int) -> None:
        now = engine.table(name)
        rows = engine._complete(now, batch, names)
        keys = [k for _, k in now.unique_keys()][:1]
        change = dml.upsert(engine.store, now, rows, dict(engine.tables), keys, None) if keys else dml.insert(engine.store, now, rows, dict(engine.tables))
        engine.put(change.table)
        engine._publish()

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
