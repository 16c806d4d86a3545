"""Writers: append, partitioned append, JDBC, error rows, versioned publish."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loadkit.functions.columns import ts_literal
from loadkit.session import compressed

# Files above this many rows are split; keeps files an even size at any scale.
MAX_RECORDS_PER_FILE = 5_000_000


def _writer(df: DataFrame, fmt: str, mode: str, partition_by: Sequence[str] | None):
    w = df.write.format(fmt).mode(mode).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
    if fmt == "parquet":
        w = compressed(df.sparkSession, w)
    if partition_by:
        w = w.partitionBy(*partition_by)
    return w


# --------------------------------------------------------------------------- SNK1/2
def append(df: DataFrame, path: str, *, fmt: str = "parquet",
           partition_by: Sequence[str] | None = None,
           replace_partitions: bool = False) -> None:
    """Append to a path, optionally partitioned.

    Partitioned writes go through a REBALANCE on the partition columns:
    each task then writes few partition directories (no small-file
    explosion), and AQE splits a hot partition value over several tasks
    instead of funnelling it into one.  ``replace_partitions`` overwrites
    only the partitions present in ``df`` (dynamic overwrite), so re-running
    a batch does not duplicate it.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    mode = "overwrite" if replace_partitions else "append"
    w = _writer(df, fmt, mode, partition_by)
    if replace_partitions:
        if not partition_by:
            raise ValueError("replace_partitions needs partition columns")
        w = w.option("partitionOverwriteMode", "dynamic")
    w.save(path)


def replace(df: DataFrame, path: str, *, fmt: str = "parquet") -> None:
    """Write ``df`` in place of what ``path`` holds.  Spark refuses a frame
    that reads from ``path``; publish a version for that."""
    _writer(df, fmt, "overwrite", None).save(path)


def write_split(df: DataFrame, cases, path: str, *, default: str = "default",
                label: str = "split_output", fmt: str = "parquet") -> None:
    """Write every output of a conditional split in one job.

    Rows are labelled by the first true case (``routing.label_split``) and
    appended partitioned by the label, so output ``name`` is the folder
    ``<path>/<label>=<name>``.  One scan of the input, however many outputs;
    the rebalance spreads a large output over many tasks.
    """
    from loadkit.operators.routing import label_split
    append(label_split(df, cases, default, label), path, fmt=fmt, partition_by=[label])


# --------------------------------------------------------------------------- SNK3
def write_jdbc(df: DataFrame, url: str, table: str, *, mode: str = "append",
               batch_size: int = 1000, num_partitions: int | None = None,
               properties: Mapping[str, str] | None = None) -> None:
    """JDBC insert in batches; ``num_partitions`` caps concurrent connections."""
    w = (df.write.format("jdbc").mode(mode)
         .option("url", url).option("dbtable", table).option("batchsize", str(batch_size)))
    if num_partitions:
        w = w.option("numPartitions", str(num_partitions))
    for k, v in (properties or {}).items():
        w = w.option(k, v)
    w.save()


# --------------------------------------------------------------------------- SNK4
def tag_error_rows(errors: DataFrame, pipeline: str, stage: str, batch_id: str,
                   error_ts=None) -> DataFrame:
    return errors.withColumns({
        "pipeline": F.lit(pipeline),
        "stage": F.lit(stage),
        "batch_id": F.lit(batch_id),
        "error_timestamp": ts_literal(error_ts),
    })


def write_error_rows(errors: DataFrame, path: str, pipeline: str, stage: str, batch_id: str,
                     error_ts=None, *, once: bool = False) -> None:
    """Append tagged error rows, partitioned by pipeline.

    The source columns of different loads differ, so each load gets its own
    partition directory; read one pipeline's errors back by that directory.
    ``once``: as a published batch, which a load that runs again under its
    ``batch_id`` does not repeat (read it by ``sinks.batches.read_batches``).
    """
    tagged = tag_error_rows(errors, pipeline, stage, batch_id, error_ts).drop("pipeline")
    folder = f"{path.rstrip('/')}/pipeline={pipeline}"
    if once:
        from loadkit.sinks.batches import append_batch
        append_batch(tagged, folder, f"{batch_id}/{stage}")
    else:
        append(tagged, folder)


# --------------------------------------------------------------------------- publish
def publish_version(spark: SparkSession, df: DataFrame, table: str, root: str, *,
                    fmt: str = "parquet", observation: Observation | None = None) -> str:
    """Write ``df`` as a new version directory and point ``table`` at it.

    Readers of the old version are never disturbed, and the plan that
    produced ``df`` may read the old version (an SCD merge does).
    """
    version = f"{root.rstrip('/')}/{table}/v-{uuid.uuid4().hex}"
    out = df.observe(observation, F.count(F.lit(1)).alias("rows")) if observation else df
    out.write.format(fmt).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).save(version)
    if spark.catalog.tableExists(table):
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{version}'")
        spark.sql(f"REFRESH TABLE {table}")
    else:
        spark.catalog.createTable(table, path=version, source=fmt)
    return version
