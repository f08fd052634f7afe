"""Index maintenance: change detection, upserts, event buffers, status and latency figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def content_hash(column: str = "content"):
    return F.sha1(F.col(column).cast("binary"))


def changed(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Of files (path, content): path, hash, state (new or changed) where stored (path, sha1_hex) lacks it or differs."""
    now = files.select("path", content_hash().alias("hash"))
    rows = now.join(stored, "path", "left").where("sha1_hex is null or sha1_hex <> hash")
    return rows.select("path", "hash", F.when(F.col("sha1_hex").isNull(), "new").otherwise("changed").alias("state"))


def deleted(files: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.join(files.select("path"), "path", "left_anti").select("path")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(keys).distinct(), keys, "left_anti").unionByName(new)


def remove(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(keys).distinct(), keys, "left_anti")


def ring_buffer(events: DataFrame, capacity: int = 10_000, order: str = "seq") -> DataFrame:
    """The newest capacity events; capacity 0 or less means 10,000. A top-k, not a sort of all."""
    n = capacity if capacity > 0 else 10_000
    return events.orderBy(F.desc(order)).limit(n)


def events_of(events: DataFrame, func_id=None, var_name=None) -> DataFrame:
    rows = events
    if func_id is not None:
        rows = rows.where(F.col("func_id") == func_id)
    return rows if var_name is None else rows.where(F.col("var_name") == var_name)


def percentiles(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """n, min, median (element n/2 from 0), p95 and p99 (nearest rank, rounded up), max of each group."""
    w = Window.partitionBy(*by)
    rows = values.where(F.col(column).isNotNull()).withColumn("rank", F.row_number().over(w.orderBy(column))).withColumn("n", F.count("*").over(w))
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col(column)))
    near = lambda p: F.greatest(F.ceil(F.col("n") * F.lit(p) / 100), F.lit(1))
    return rows.groupBy(*by).agg(F.max("n").alias("n"), F.min(column).alias("min"), at(F.floor(F.col("n") / 2) + 1).alias("median"), at(near(95)).alias("p95"), at(near(99)).alias("p99"), F.max(column).alias("max"))


def distributed_sample(items: DataFrame, column: str, n: int) -> DataFrame:
    """n evenly spaced picks from the sorted distinct values, all if there are no more than n.

    A value's place is its range's offset plus its place within the range, from two passes, so no task sorts all values.
    """
    distinct = items.select(column).where(F.col(column).isNotNull()).distinct()
    ranged = distinct.repartitionByRange(column).withColumn("part", F.spark_partition_id())
    from codeloom.tables import written

    ranged = written(ranged, "ranges")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("size"), F.min(column).alias("first"))
    offsets = sizes.select("part", (F.sum("size").over(Window.orderBy("first")) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy(F.lit(0))).alias("total"))
    placed = ranged.join(F.broadcast(offsets), "part").withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(column)) - 1 + F.col("before"))
    picked = F.floor(F.ceil(F.col("at") * n / F.col("total")) * F.col("total") / n) == F.col("at")
    return placed.where((F.col("total") <= n) | picked).select(column)


def line_stats(files: DataFrame) -> DataFrame:
    """files and lines (line feeds) of files (path, content)."""
    return files.agg(F.count("*").alias("files"), F.sum(F.length("content") - F.length(F.replace("content", F.lit("\n")))).alias("lines"))


def status(counts: dict[str, DataFrame], version: str = "0.1") -> DataFrame:
    """One row: a count for each relation, version, and whether there is anything to search."""
    out = None
    for name, rows in counts.items():
        one = rows.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)
    first = next(iter(counts))
    return out.withColumn("version", F.lit(version)).withColumn("ready", F.col(first) > 0)


def trace_runtime(events: DataFrame, text: str) -> DataFrame:
    """Recorded events (seq, func_id, var_name, ...) of a function, if text holds a dot, else of a variable, in order."""
    return (events_of(events, func_id=text) if "." in text else events_of(events, var_name=text)).orderBy("seq")
