"""Dimensions in hash buckets: a merge rewrites only the buckets its source touches.

A version of the dimension is a manifest that names the folder of each bucket.
A merge reads the buckets that hold a source key, writes their next contents
to new folders and publishes a manifest that points there, and at the old
folders for all other buckets.  Versions are numbered; a number can be
published once, so of two merges that started from one version the second is
refused (``VersionConflict``) and must run again.  Readers of an earlier
version keep its folders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadkit.sinks.ledger import create_entry, entry_names, read_entry
from loadkit.sinks.tables import MAX_RECORDS_PER_FILE

BUCKET = "load_bucket"


class VersionConflict(RuntimeError):
    """Another merge published a version since this one read the table."""


@dataclass
class BucketedTable:
    """A dimension at ``path``; ``keys`` decide the bucket, ``buckets`` is fixed when it is created."""

    spark: SparkSession
    path: str
    keys: list[str]
    buckets: int
    schema: T.StructType

    def _bucket(self) -> Column:
        types = {f.name: f.dataType for f in self.schema.fields}
        return F.pmod(F.xxhash64(*[F.col(k).cast(types[k]) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        names = entry_names(self.spark, f"{self.path}/_versions")
        return int(names[-1]) if names else -1

    def folders(self, version: int | None = None) -> dict[int, str]:
        """bucket -> folder of a version (the last by default); empty buckets have none."""
        version = self.version() if version is None else version
        entry = read_entry(self.spark, f"{self.path}/_versions/{version:018d}") if version >= 0 else None
        return {int(b): f for b, f in (entry or {"folders": {}})["folders"].items()}

    def _frame(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in sorted(set(folders))])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version (the last by default)."""
        return self._frame(list(self.folders(version).values()))

    def _write(self, df: DataFrame) -> dict[int, str]:
        """Write rows to new bucket folders and name them."""
        folder = f"data/{uuid.uuid4().hex}"
        out = df.select(*self.schema.names).withColumn(BUCKET, self._bucket())
        (out.hint("rebalance", BUCKET).write.partitionBy(BUCKET).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
         .parquet(f"{self.path}/{folder}"))
        names = entry_names(self.spark, f"{self.path}/{folder}")
        found = [int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}=")]
        return {b: f"{folder}/{BUCKET}={b}" for b in found}

    def merge(self, source: DataFrame, rewrite: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the touched buckets by ``rewrite(their rows, source)``; returns the buckets rewritten.

        ``rewrite`` must keep each key in its bucket, as the merges of ``operators.scd`` do.  The bucket numbers of
        the source, at most ``buckets``, come to the driver.  An empty source publishes nothing.
        """
        version = self.version()
        folders = self.folders(version)
        touched = sorted(r[0] for r in source.select(self._bucket().alias(BUCKET)).distinct().collect())
        if not touched:
            return []
        before = self._frame([folders[b] for b in touched if b in folders])
        written = self._write(rewrite(before, source))
        strange = sorted(set(written) - set(touched))
        if strange:
            raise ValueError(f"rows came out in buckets {strange}, which the source does not touch")
        rest = {b: f for b, f in folders.items() if b not in touched}
        self._publish(version + 1, {**rest, **written})
        return touched

    def _publish(self, version: int, folders: dict[int, str]) -> None:
        content = {"keys": self.keys, "buckets": self.buckets, "schema": self.schema.jsonValue(),
                   "folders": {str(b): f for b, f in folders.items()}}
        if not create_entry(self.spark, f"{self.path}/_versions/{version:018d}", content):
            raise VersionConflict(f"version {version} of {self.path} was published by another merge")


def create_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> BucketedTable:
    """Write ``df`` as version 0 of a new bucketed dimension."""
    table = BucketedTable(df.sparkSession, path.rstrip("/"), list(keys), buckets, df.schema)
    table._publish(0, table._write(df))
    return table


def open_bucketed(spark: SparkSession, path: str) -> BucketedTable:
    """The bucketed dimension at ``path``, as its last manifest describes it."""
    names = entry_names(spark, f"{path}/_versions")
    if not names:
        raise FileNotFoundError(f"no bucketed dimension at {path}")
    entry = read_entry(spark, f"{path}/_versions/{names[-1]}")
    return BucketedTable(spark, path.rstrip("/"), entry["keys"], entry["buckets"],
                         T.StructType.fromJson(entry["schema"]))
