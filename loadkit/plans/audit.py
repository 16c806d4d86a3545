"""Run records of a load: reads, errors, writes, final status.

The records are a handful of counts per run, kept on the driver and
appended to an audit table as one small frame.  The counts themselves come
from Spark (``Observation`` on the jobs that already run), never from extra
passes over the data.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

AUDIT_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("batch_id", T.StringType()),
    T.StructField("pipeline", T.StringType()),
    T.StructField("seq", T.IntegerType()),
    T.StructField("stage", T.StringType()),
    T.StructField("object", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("rows", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("message", T.StringType()),
])


@dataclass
class AuditTrail:
    pipeline: str
    batch_id: str = field(default_factory=lambda: f"batch-{uuid.uuid4().hex[:16]}")
    records: list[tuple] = field(default_factory=list)
    status: str = "created"

    def _add(self, stage, obj, kind, rows, status, message=None):
        self.records.append((dt.datetime.now(dt.timezone.utc), self.batch_id, self.pipeline, len(self.records) + 1, stage, obj,
                             kind, None if rows is None else int(rows), status, message))

    def start(self) -> None:
        self.status = "running"
        self._add("run", self.pipeline, "start", None, "running")

    def record_read(self, obj: str, rows: int, stage: str = "read") -> None:
        self._add(stage, obj, "read", rows, "ok")

    def record_errors(self, stage: str, rows: int, obj: str = "error_rows") -> None:
        self._add(stage, obj, "error", rows, "ok")

    def record_dropped(self, stage: str, rows: int, obj: str = "duplicates") -> None:
        self._add(stage, obj, "dropped", rows, "ok")

    def record_write(self, obj: str, rows: int, stage: str = "write") -> None:
        self._add(stage, obj, "write", rows, "ok")

    def record_reused(self, step: str) -> None:
        """A step taken over from an earlier run of the batch."""
        self._add(step, "step", "reuse", None, "ok")

    def complete(self, message: str | None = None) -> None:
        self.status = "complete"
        self._add("run", self.pipeline, "end", None, "complete", message)

    def fail(self, message: str) -> None:
        self.status = "failed"
        self._add("run", self.pipeline, "end", None, "failed", message)

    def count(self, kind: str, obj: str | None = None) -> int:
        return sum(r[7] or 0 for r in self.records
                   if r[6] == kind and (obj is None or r[5] == obj))

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.records, AUDIT_SCHEMA)

    def write(self, spark: SparkSession, path: str) -> None:
        self.to_frame(spark).coalesce(1).write.mode("append").parquet(path)
