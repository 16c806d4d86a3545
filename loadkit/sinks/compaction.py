"""Compaction of a table of published batches (``sinks.batches``).

Many small batches leave many small files.  Compaction rewrites the rows of
several batch folders into one new folder, REBALANCEd by the partition columns
so that a partition value gets as few files as its size asks for, and swaps it
in by one create-if-absent entry ``_compactions/<n>`` that names the new folder
and those it replaces.  Old folders stay where they are: a reader that has
listed them is not disturbed, and a batch stays known under its id.

Folders are merged with others of like size (the largest of a group is at most
``factor`` times its smallest) and only ``min_folders`` or more at once.  So a
row is rewritten a number of times that grows with the logarithm of the table,
and a large folder is left alone until others have grown to its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from loadkit.sinks.batches import COMPACTIONS, compactions, live_folders, read_folders, write_batch
from loadkit.sinks.ledger import create_entry

MIN_FOLDERS, FACTOR = 4, 4


def folder_bytes(spark: SparkSession, path: str) -> int:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(hpath).getLength())


def like_sized(sizes: dict[str, int], min_folders: int, factor: float) -> list[str]:
    """The smallest folders that are at least ``min_folders`` of like size; none if there are no such."""
    ordered = sorted(sizes, key=lambda f: (sizes[f], f))
    at = 0
    while at < len(ordered):
        group = [f for f in ordered[at:] if sizes[f] <= factor * max(sizes[ordered[at]], 1)]
        if len(group) >= min_folders:
            return group
        at += len(group)
    return []


def swap(spark: SparkSession, path: str, folder: str, replaces: Sequence[str]) -> bool:
    """Put ``folder`` in the place of others; False if another compaction has replaced one of them."""
    while True:
        done = compactions(spark, path)
        if {f for c in done for f in c["replaces"]} & set(replaces):
            return False
        if create_entry(spark, f"{path}/{COMPACTIONS}/{len(done):018d}",
                        {"folder": folder, "replaces": sorted(replaces)}):
            return True


def compact(spark: SparkSession, path: str, schema: T.StructType, *, partition_by: Sequence[str] | None = None,
            min_folders: int = MIN_FOLDERS, factor: float = FACTOR) -> list[dict]:
    """Merge folders of like size until there are too few of any size.

    Returns one record a merge: the new folder, those it replaced and whether
    it was swapped in (a merge that lost to another one running at once is not,
    and ends the call; its folder is never read).  Rows, repeated and null ones
    included, are the same before and after.  An empty table is left alone.
    """
    if min_folders < 2 or factor < 1:
        raise ValueError("compaction merges two folders at least, of sizes up to one factor of 1 or more")
    merged = []
    while True:
        sizes = {f: folder_bytes(spark, f"{path}/{f}") for f in live_folders(spark, path)}
        group = like_sized(sizes, min_folders, factor)
        if not group:
            return merged
        rows = read_folders(spark, path, group, schema)
        if not partition_by:
            rows = rows.hint("rebalance")  # with partition columns the write asks for it by itself
        folder = write_batch(rows, path, partition_by=partition_by)
        swapped = swap(spark, path, folder, group)
        merged.append({"folder": folder, "replaces": group, "swapped": swapped})
        if not swapped:
            return merged
