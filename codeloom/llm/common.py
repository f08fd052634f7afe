"""Helpers that the corpus operators share: written intermediate tables, Arrow streams and graph components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every operator of this subpackage.
SPACE = r"[\x20\x09-\x0D]+"
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Word separators other than the blank, as a str.translate table: with them mapped, str.split(" ") yields the words and empty strings.
BLANKS = {c: " " for c in range(0x09, 0x0E)}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where the session names none (tests) a local one is set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return (found or "/tmp/checkpoints").rstrip("/")


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df, computed once and read back from a Parquet table in the shared folder: cuts lineage, and outlives lost executors. codec: zstd makes tables of texts a third smaller."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codeloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what written() wrote for df, which nothing may read any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Lets the cleaner delete the shuffle files of queries that ended; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


#: Words of 64 bits in sifted()'s table, as a power of two.
SIEVE = 18


def sifted(rows: DataFrame, column: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose column may be among ids (one BIGINT column), and those whose is surely not, without a shuffle of rows.

    A table of 2 MB, whatever the number of ids, has a bit for each id's hash; the more ids, the more rows only may be.
    """
    spark = rows.sparkSession
    place = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - SIEVE)
    bit = lambda c: F.expr(f"shiftleft(1L, cast(xxhash64({c}) & 63 as int))")
    name = ids.columns[0]
    found = ids.groupBy(place(F.col(name)).alias("place")).agg(F.bit_or(bit(name)).alias("word")).toArrow()
    table = np.zeros(1 << SIEVE, "i8")
    table[found.column("place").to_numpy()] = found.column("word").to_numpy()
    one = F.broadcast(spark.createDataFrame([(table.tolist(),)], "sieve array<long>", verifySchema=False))
    own = F.col("sieve")[place(F.col(column)).cast("int")].bitwiseAND(bit(column)) != 0
    return rows.join(one, own, "left_semi"), rows.join(one, own, "left_anti")


def hold(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of long texts stays small beside a Python worker's tables."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


@contextmanager
def uncollected():
    """No search for reference cycles meanwhile: with a million live strings it costs more than the work, and there are no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def mapped(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with a function that turns a batch into columns (a dict of lists or arrays); schema is a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    hold(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in rows(batch):
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def words_of(text: str) -> list[str]:
    """Maximal runs without the six ASCII white-space characters."""
    return [w for w in text.translate(BLANKS).split(" ") if w]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), both BIGINT: rows (node, component) for every node, component being the smallest node reachable.

    Alternates the large-star and small-star steps until no edge changes; each step is two hash aggregations and a
    join, each round is written to the shared folder, and only two scalars a round reach the driver.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        ends = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        # written, so that both sides of the join are dealt for it alone, and a large star's rows can be split over tasks
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        near = both.where("v > u") if large else both.where("v < u")
        joined = near.join(least, "u")
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    e = written(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct(), "edges")
    before = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        e = written(star(star(e, True), False), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
