"""Versioned tables in a shared folder: every commit changes any number of tables at once.

A commit writes the changed tables under new paths, then one manifest that names every table's path. The manifest's
folder is the version, and Spark refuses to write a folder that exists, so of two writers of one version the second
fails and nothing of it shows. Readers take the highest version's manifest; a lost executor or job leaves no half commit.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import maintenance
from codeloom.tables import shared_dir


class Store:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or f"{shared_dir(spark)}/codeloom/store").rstrip("/")

    def manifest(self, version: int | None = None) -> tuple[int, dict[str, str]]:
        """A version (the newest by default) and the path of each of its tables; version 0 is empty."""
        try:
            rows = self.spark.read.schema("name string, path string, version long").parquet(f"{self.root}/manifest")
        except AnalysisException:
            return 0, {}
        if version is None:
            version = rows.agg(F.max("version")).first()[0] or 0
        return version, {r.name: r.path for r in rows.where(F.col("version") == version).collect()}  # one row a table

    def table(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table as of a version, or None if it has none."""
        path = self.manifest(version)[1].get(name)
        return None if path is None else self.spark.read.parquet(path)

    def commit(self, puts: dict[str, tuple[DataFrame, list[str]]] | None = None, deletes: dict[str, tuple[DataFrame, list[str]]] | None = None, prefixes: dict[str, tuple[str, list[str]]] | None = None, replace: dict[str, DataFrame] | None = None) -> int:
        """One version more, and its number. Of each table first go the rows with the keys of deletes and those where a column
        starts with one of prefixes; then rows of puts replace those with equal keys. replace gives whole tables.

        Among puts with equal keys any one stays. Raises if another writer took the version meanwhile.
        """
        puts, deletes, prefixes, replace = puts or {}, deletes or {}, prefixes or {}, replace or {}
        version, paths = self.manifest()
        for name in {*puts, *deletes, *prefixes, *replace}:
            rows = self.spark.read.parquet(paths[name]) if name in paths else None
            if name in replace:
                rows = replace[name]
            if rows is not None and name in deletes:
                rows = maintenance.remove(rows, *deletes[name])
            if rows is not None and name in prefixes:
                column, starts = prefixes[name]
                for start in starts:
                    rows = rows.where(F.coalesce(~F.startswith(column, F.lit(start)), F.lit(True)))
            if name in puts:
                new, keys = puts[name]
                new = new.dropDuplicates(keys)
                rows = new if rows is None else maintenance.upsert(rows, new, keys)
            if rows is not None:
                paths[name] = f"{self.root}/tables/{name}/{uuid.uuid4().hex}"
                rows.write.parquet(paths[name])
        names = self.spark.createDataFrame(sorted(paths.items()), "name string, path string")
        try:
            names.coalesce(1).write.mode("error").parquet(f"{self.root}/manifest/version={version + 1}")
        except (AnalysisException, Py4JJavaError) as e:
            raise RuntimeError(f"version {version + 1} was written by another writer") from e
        return version + 1

    def get(self, name: str, column: str, value) -> DataFrame:
        return self.table(name).where(F.col(column) == F.lit(value))

    def with_prefix(self, name: str, column: str, prefix: str) -> DataFrame:
        return self.table(name).where(F.startswith(column, F.lit(prefix)))

    def has_prefix(self, name: str, column: str, prefix: str) -> bool:
        return not self.with_prefix(name, column, prefix).isEmpty()
