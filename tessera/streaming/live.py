"""Live submissions as a stream: validated, serialised, and merged into the vector table batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.records import last_wins, valid_rows
from tessera.operators.retrieval import BM25Index
from tessera.sources.files import VectorTable, append_jsonl


def add_live(rows: DataFrame, prepare: Callable[[DataFrame], DataFrame], table: VectorTable, index: BM25Index | None = None, records: str | None = None) -> None:
    """Adds records everywhere they are looked up: appended to the record file, upserted as vectors, and put into the lexical index with new statistics.

    prepare(rows) has id, seq and, for the index, text. Of rows that repeat an id the one of the highest seq goes into table and index.
    """
    rows = rows.persist()
    try:
        if records:
            append_jsonl(rows, records)
        ready = last_wins(prepare(rows).filter("id is not null"), table.key, table.seq).persist()
        if ready.head(1):
            table.upsert(ready)
            if index:
                index.add(ready.select("id", "text"))
        ready.unpersist()
    finally:
        rows.unpersist()


def stream_submissions(spark: SparkSession, path: str, schema: str, required: tuple[str, ...], prepare: Callable[[DataFrame], DataFrame], table: VectorTable, checkpoint: str, index: BM25Index | None = None, records: str | None = None) -> StreamingQuery:
    """JSON files under path -> valid rows -> prepare(rows) with id, seq and, for the index, text -> add_live(). Ends when all present files are read."""
    rows = spark.readStream.schema(schema).json(path)

    def merge(batch: DataFrame, _: int) -> None:
        add_live(valid_rows(batch, *required)[0], prepare, table, index, records)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
