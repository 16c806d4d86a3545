"""Labelled samples and one-task training shared by the classifiers.

A model is fitted on at most ``PER_CLASS`` labelled documents of each class,
those with the smallest hashes of their ids, so the sample is the same on
every run and spreads over the table.  It is fitted inside one Spark task;
only the finished model, of fixed size, comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadkit.llm.lean import lean

PER_CLASS = 3000


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, columns: Sequence[Column], *,
                    id_column: str = "doc_id", per_class: int = PER_CLASS) -> DataFrame:
    """The sample: ``__order`` long, ``__label`` int, ``__weight`` double, then ``columns`` of ``documents``.

    ``__weight`` is the class's size over its sampled size.  Rows of
    ``labels`` with a null id or label, and held-out ones, are left out; an id
    labelled twice has its largest label.  An id with several documents has
    the smallest of them, so the sample is bounded whatever repeats.
    """
    known = (labels.select(labels["doc_id"].alias("__id"), labels[label].cast("int").alias("__label"))
             .filter(F.col("__id").isNotNull() & F.col("__label").isNotNull() & ~held_out(F.col("__id")))
             .groupBy("__id").agg(F.max("__label").alias("__label")).withColumn("__order", F.xxhash64("__id")))
    sizes = {r["__label"]: r["n"] for r in known.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    parts = [known.filter(F.col("__label") == k).orderBy("__order", "__id").limit(per_class)
             .withColumn("__weight", F.lit(n / min(n, per_class))) for k, n in sorted(sizes.items())]
    if not parts:
        parts = [known.withColumn("__weight", F.lit(1.0)).limit(0)]
    picked = parts[0]
    for p in parts[1:]:
        picked = picked.union(p)
    # At most per_class rows a class: small enough to send everywhere.
    named = documents.select(documents[id_column].alias("__of"), F.struct(*columns).alias("__row"))
    return (named.join(F.broadcast(picked), F.col("__of") == F.col("__id"))
            .groupBy("__order", "__id", "__label", "__weight").agg(F.min("__row").alias("__row"))
            .select("__order", "__label", "__weight", "__row.*"))


def fit_in_one_task(rows: DataFrame, fit: Callable[[pa.Table], bytes | None]) -> bytes | None:
    """``fit`` of all of ``rows`` (a bounded sample) in one task, sorted by its first column."""
    @lean
    def run(batches):
        batches = list(batches)
        if batches:
            rows = [pa.Table.from_batches(batches)]
            batches.clear()
            made = fit(rows.pop())
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["model"])

    got = rows.repartition(1).sortWithinPartitions(*rows.columns[:2]).mapInArrow(run, "model binary").collect()
    return bytes(got[0]["model"]) if got else None


