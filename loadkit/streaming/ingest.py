"""Restartable file ingest with Structured Streaming.

A re-run continues after the last completed input: the file source records
every file it has taken in the checkpoint.  ``trigger(availableNow=True)``
turns that into a batch job: take everything new, in bounded micro-batches,
then stop.  Each micro-batch is routed and written to its own partition
``ingest_batch=<n>``, replacing what a run that died halfway left there, so
every batch lands exactly once.  The number comes from a ledger beside the
target, which gives each (checkpoint, epoch) one of its own: several sources,
and a checkpoint that was lost and begun anew, never get each other's.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadkit.functions.columns import ts_literal
from loadkit.operators.routing import enforce_error_limit
from loadkit.operators.transforms import drop_raw_columns, type_conversions
from loadkit.plans.staging import route_and_stage
from loadkit.session import path_exists
from loadkit.sinks.ledger import read_entry, take_number
from loadkit.sources.readers import CORRUPT, corrupt_rule, string_schema

BATCH_COLUMN = "ingest_batch"
LEDGER = "_ingest_ledger"
TEXT_FORMATS = ("csv", "json")


class _Writer:
    """foreachBatch body: convert, route, check the limit, write; counts per batch.

    The batch is staged once in the shared folder (``route_and_stage``), not
    kept in executor memory; its counts come from that write.
    """

    def __init__(self, target, error_path, partition_by, rules, conversions, error_limit, label, checkpoint):
        self.target, self.error_path, self.label = target.rstrip("/"), error_path, label
        self.checkpoint = checkpoint.rstrip("/")
        self.parts = [BATCH_COLUMN, *(partition_by or [])]
        self.rules, self.conversions, self.error_limit = rules, conversions, error_limit
        self.read: dict[int, int] = {}
        self.errors: dict[int, int] = {}

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        rules = list(self.rules)
        if self.conversions:
            batch, bad = type_conversions(batch, self.conversions)
            rules = [corrupt_rule(), *bad, *rules]
        routed, _ = route_and_stage(batch, rules, f"{self.label}-{epoch}")
        self.read[epoch], self.errors[epoch] = routed.rows, routed.error_rows
        enforce_error_limit(sum(self.errors.values()), self.error_limit)
        # The stream's own id, made with its checkpoint, tells this checkpoint from all others.
        stream = read_entry(batch.sparkSession, f"{self.checkpoint}/metadata")["id"]
        number = F.lit(take_number(batch.sparkSession, f"{self.target}/{LEDGER}", f"{stream}:{epoch}")).cast("long")
        valid = drop_raw_columns(routed.valid).drop(CORRUPT).withColumn(BATCH_COLUMN, number)
        self.write(valid, self.target, self.parts)
        if self.error_path:
            self.write(routed.errors.withColumn(BATCH_COLUMN, number), self.error_path, [BATCH_COLUMN])

    @staticmethod
    def write(df: DataFrame, path: str, parts: Sequence[str]) -> None:
        (df.write.format("parquet").mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*parts).save(path))


def ingest_new_files(spark: SparkSession, source_glob: str, schema: T.StructType, *,
                     target: str, checkpoint: str, fmt: str = "csv",
                     options: Mapping[str, str] | None = None,
                     load_ts: dt.datetime | str | None = None,
                     max_files_per_trigger: int | None = 1000,
                     partition_by: Sequence[str] | None = None,
                     rules: Sequence[dict] | None = None,
                     error_path: str | None = None, error_limit: int | None = None,
                     audit=None, audit_path: str | None = None) -> dict:
    """Append every not-yet-ingested file under ``source_glob`` to ``target``.

    Text formats are read as strings and converted to ``schema``: a malformed
    line (rule ``malformed_line``), a value that does not convert
    (``bad_<column>``) and a row that fails one of ``rules`` go to
    ``error_path`` with their reasons, never to the target as a null.  Without
    ``error_path`` such a row stops the run, unless ``error_limit`` says how
    many of a run's error rows may be left out.  A batch over the limit is not
    written and is taken again by the next run; batches of the run before it
    are published already (with ``max_files_per_trigger`` of one file, the
    files before the bad one).  Both outputs are partitioned by
    ``ingest_batch``, numbered per target; rows carry ``source_file`` (full path) and
    ``load_timestamp``.

    Returns rows read, error rows, rows written and micro-batches of this run,
    counted by the batches' own writes.  With an ``AuditTrail`` the run is
    recorded there, failures included, and appended to ``audit_path``.
    """
    if path_exists(spark, f"{target.rstrip('/')}/_spark_metadata"):
        raise ValueError(f"{target} is kept by a streaming file sink, whose log would hide these rows; "
                         "ingest into a new folder")
    if error_limit is None and not error_path:
        error_limit = 0
    text = fmt in TEXT_FORMATS
    conversions = {f.name: f.dataType.simpleString() for f in schema} if text else {}
    reader = spark.readStream.format(fmt).schema(string_schema(schema.names, True) if text else schema)
    if text:
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream: DataFrame = reader.load(source_glob).withColumns({
        "source_file": F.col("_metadata.file_path"),
        "load_timestamp": ts_literal(load_ts),
    })
    write = _Writer(target, error_path, partition_by, rules or [], conversions, error_limit,
                    audit.pipeline if audit is not None else "ingest", checkpoint)
    if audit is not None:
        audit.start()
    try:
        query = (stream.writeStream.option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).foreachBatch(write).start())
        query.awaitTermination()
    except Exception as e:
        if audit is not None:
            audit.record_read("new_files", sum(write.read.values()))
            audit.record_errors("ingest", sum(write.errors.values()))
            audit.fail(f"{type(e).__name__}: {e}")
            if audit_path:
                audit.write(spark, audit_path)
        raise
    rows, errors = sum(write.read.values()), sum(write.errors.values())
    batches = sum(1 for n in write.read.values() if n)
    if audit is not None:
        audit.record_read("new_files", rows)
        audit.record_errors("ingest", errors)
        audit.record_write("target", rows - errors)
        audit.complete(f"{batches} micro-batches")
        if audit_path:
            audit.write(spark, audit_path)
    return {"rows": rows, "errors": errors, "written": rows - errors, "batches": batches}
