"""Streaming variants: postings of arriving documents and windows of trace events, as Structured Streaming plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.functions import text as T
from codeloom.operators import maintenance
from codeloom.sources.store import Store


def source(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder to which Parquet files are added, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def postings(docs: DataFrame) -> DataFrame:
    """term and its number of occurrences and documents so far, of a stream of (id, content): a stateful sum whose state is one row a term."""
    counted = docs.select("id", F.explode(F.array_distinct(T.terms(F.col("content")))).alias("term"))
    return counted.groupBy("term").agg(F.count("*").alias("df"))


def event_windows(events: DataFrame, length: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """func_id, event_type and number of events of each window of event time; events later than late are left out, and so state stays bounded."""
    return events.withWatermark("timestamp", late).groupBy(F.window("timestamp", length), "func_id", "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "func_id", "event_type", "n")


def into_store(rows: DataFrame, store: Store, table: str, keys: list[str], checkpoint: str, capacity: int | None = None) -> StreamingQuery:
    """Upserts a stream into a table of the store, one version a micro-batch; a batch that is run again gives the same table.

    capacity keeps the newest rows by seq only (a ring buffer). Runs once over what is there; call it again for more.
    """

    def put(batch: DataFrame, _: int) -> None:
        old = store.table(table)
        rows = batch.dropDuplicates(keys) if old is None else maintenance.upsert(old, batch.dropDuplicates(keys), keys)
        store.commit(replace={table: rows if capacity is None else maintenance.ring_buffer(rows, capacity)})

    return rows.writeStream.outputMode("append" if capacity is not None else "update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
