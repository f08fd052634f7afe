"""Reading the input tables, and tables in the shared folder that cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a local one only where it names none."""
    return (spark.sparkContext.getConf().get("spark.checkpoint.dir") or "/tmp/checkpoints").rstrip("/")


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df computed once, and read back from Parquet: later stages restart from there if executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/codeloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
