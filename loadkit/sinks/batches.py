"""Idempotent appends: a batch's rows are published by one manifest entry.

A batch is written to a folder of its own below ``<path>/batches`` and becomes
part of the table when its entry in ``<path>/_manifest`` is created, which can
happen once for a batch id.  A load that died after its write has left a
folder no entry names; running it again with the same id writes and publishes
the rows once.  A batch that is published already is not written again.

Readers list the manifest (one entry a batch) and read the folders it names,
or those that a compaction (``sinks.compaction``) has put in their place.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loadkit.sinks.ledger import create_entry, entry_names, key_name, read_entry
from loadkit.sinks.tables import append

MANIFEST, COMPACTIONS, FOLDER = "_manifest", "_compactions", "load_batch"


def published(spark: SparkSession, path: str, batch_id: str) -> dict | None:
    """The manifest entry of a batch; None if it is not part of the table."""
    return read_entry(spark, f"{path}/{MANIFEST}/{key_name(batch_id)}")


def write_batch(df: DataFrame, path: str, *, partition_by: Sequence[str] | None = None) -> str:
    """Write a batch's rows to a new folder and return its name; no reader sees them yet."""
    folder = f"batches/{FOLDER}={uuid.uuid4().hex}"
    append(df, f"{path}/{folder}", partition_by=partition_by)
    return folder


def publish_batch(spark: SparkSession, path: str, batch_id: str, folder: str, rows: int | None = None) -> bool:
    """Make a written folder part of the table; False if the batch was published before."""
    return create_entry(spark, f"{path}/{MANIFEST}/{key_name(batch_id)}",
                        {"batch_id": batch_id, "folder": folder, "rows": rows})


def append_batch(df: DataFrame, path: str, batch_id: str, *, partition_by: Sequence[str] | None = None) -> bool:
    """Append ``df`` as batch ``batch_id``, once however often it is run; False if it was there already."""
    spark = df.sparkSession
    if published(spark, path, batch_id):
        return False
    return publish_batch(spark, path, batch_id, write_batch(df, path, partition_by=partition_by))


def compactions(spark: SparkSession, path: str) -> list[dict]:
    """The compactions of the table so far, in order."""
    return [read_entry(spark, f"{path}/{COMPACTIONS}/{name}") for name in entry_names(spark, f"{path}/{COMPACTIONS}")]


def live_folders(spark: SparkSession, path: str) -> list[str]:
    """The folders that hold the table's rows, each row once.

    The manifest is listed first: a compaction that comes between the two
    lists holds only rows of batches that were published by then.
    """
    own = [read_entry(spark, f"{path}/{MANIFEST}/{name}")["folder"]
           for name in entry_names(spark, f"{path}/{MANIFEST}")]
    done = compactions(spark, path)
    replaced = {f for c in done for f in c["replaces"]}
    return [f for f in [*own, *(c["folder"] for c in done)] if f not in replaced]


def read_folders(spark: SparkSession, path: str, folders: Sequence[str], schema: T.StructType) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    # A batch's own partition folders lie below its folder, which reads as one more partition column.
    full = T.StructType([*schema.fields, T.StructField(FOLDER, T.StringType())])
    read = spark.read.schema(full).option("basePath", f"{path}/batches")
    return read.parquet(*[f"{path}/{f}" for f in folders]).select(*schema.names)


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all published batches, with the columns of ``schema``."""
    return read_folders(spark, path, live_folders(spark, path), schema)
