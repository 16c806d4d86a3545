"""Stage a routed frame once, count it in the same pass, split it by reading back.

A load has two outputs (valid rows, error rows), an error limit to check
before anything is published, and counts for the audit.  Recomputing the
upstream plan (joins, de-duplication) for each of those would repeat its
shuffles, and caching a large frame in executor memory does not survive a
lost executor.  So the routed frame is written once to the shared folder,
partitioned by its route (a task keeps one file a route open, and does not sort
its rows by route).  Valid and error rows are counted in the footers of
the files it committed; an ``Observation`` on that same write counts what it
left out (and, if asked, the valid rows' byte size, which decides later
broadcasts).  The outputs are partition-pruned reads of the staged table.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import nullcontext
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loadkit.operators.lookups import row_bytes
from loadkit.operators.routing import ERROR_MESSAGES, ERROR_RULES, is_error_row, tag_errors
from loadkit.plans.early_stop import EarlyStop
from loadkit.plans.steps import Steps
from loadkit.session import compressed, files_side_by_side, scratch_path

ROUTE = "load_route"


def observed(obs: Observation) -> dict | None:
    """The metrics of a finished run; None if the plan had no place for them
    (an empty input is optimised away, and its counters with it)."""
    try:
        return dict(obs.get)
    except (Py4JError, PySparkException):
        return None


def stage(df: DataFrame, label: str, *, partition_by: Sequence[str] | None = None,
          metrics: Sequence[Column] = (), keep: Column | None = None, steps: Steps | None = None,
          committed: str | None = None, stop: EarlyStop | None = None) -> tuple[DataFrame, dict]:
    """Write ``df`` under the shared folder and read it back.

    Returns (frame, metrics) where metrics were observed on the write itself,
    ``path`` among them.  Rows outside ``keep`` are counted but not written.
    ``committed``: a partition column by which the rows of the committed files
    are counted, from their footers, as the metric of that name.  With ``steps``
    a table that an earlier run of the batch has staged is taken over, metrics
    included, and ``df`` is not run.  ``stop`` watches over the write.
    """
    spark = df.sparkSession
    schema = df.schema  # a write of no rows may leave no file to take it from

    def run() -> dict:
        path = scratch_path(spark, f"stage-{label}")
        obs = Observation(f"{label}_{path.rsplit('-', 1)[-1]}")
        out = df.observe(obs, F.count(F.lit(1)).alias("rows"), *metrics)
        if keep is not None:
            out = out.filter(keep)
        w = compressed(spark, out.write.mode("error").format("parquet"))
        if partition_by:
            w = w.partitionBy(*partition_by)
        with stop.watching() if stop else nullcontext(), files_side_by_side(spark) if partition_by else nullcontext():
            w.save(path)
        found = observed(obs)
        if found is None:
            found = df.agg(F.count(F.lit(1)).alias("rows"), *metrics).first().asDict()
        if committed:
            written = spark.read.schema(schema).parquet(path).groupBy(committed).count().collect()
            found["committed"] = {r[0]: r[1] for r in written}
        return {**found, "path": path}

    found = steps.staged("stage", schema.simpleString(), run) if steps else run()
    return spark.read.schema(schema).parquet(found["path"]), found


@dataclass
class Routed:
    valid: DataFrame
    errors: DataFrame
    rows: int
    error_rows: int
    path_frame: DataFrame
    valid_bytes: int = 0
    dropped_rows: int = 0
    path: str = ""

    @property
    def valid_rows(self) -> int:
        return self.rows - self.error_rows - self.dropped_rows


def route_and_stage(df: DataFrame, rules: Sequence[dict], label: str, *,
                    pre_tagged: DataFrame | None = None,
                    drop_when: Column | None = None,
                    extra_metrics: Sequence[Column] = (),
                    measure: bool = False, steps: Steps | None = None,
                    stop_over: int | None = None) -> tuple[Routed, dict]:
    """Tag ``df`` with ``rules``, stage it, and split it into valid and error rows.

    ``pre_tagged``: rows already carrying error arrays (e.g. null-key rows
    routed before de-duplication) to stage together with ``df``.
    ``drop_when``: rows that belong to neither output (e.g. detail rows an
    inner join would drop); they are counted, not staged.
    ``measure``: also sum the valid rows' bytes (for a later broadcast).
    ``steps``: see ``stage``.
    ``stop_over``: cancel the write once more rows than this are error rows
    (``early_stop``) and raise ``ErrorLimitExceeded``.
    """
    columns = list(df.columns)
    if rules:
        tagged = tag_errors(df, rules)
    else:
        tagged = df.withColumns({ERROR_RULES: F.array().cast("array<string>"),
                                 ERROR_MESSAGES: F.array().cast("array<string>")})
    if pre_tagged is not None:
        tagged = tagged.unionByName(pre_tagged.select(*tagged.columns))
    stop = None if stop_over is None else EarlyStop(df.sparkSession, stop_over)
    route = F.when(stop.counted(is_error_row()) if stop else is_error_row(), F.lit("error")).otherwise(F.lit("valid"))
    if drop_when is not None:
        route = F.when(F.coalesce(drop_when, F.lit(False)), F.lit("dropped")).otherwise(route)
    tagged = tagged.withColumn(ROUTE, route)
    extra = list(extra_metrics)
    if measure:
        size = F.when(F.col(ROUTE) == "valid", row_bytes(df.select(*columns)))
        extra.append(F.sum(size).alias("valid_bytes"))
    staged, metrics = stage(
        tagged, label, partition_by=[ROUTE], keep=F.col(ROUTE) != "dropped", steps=steps, stop=stop, committed=ROUTE,
        metrics=[F.count_if(F.col(ROUTE) == "dropped").alias("dropped"), *extra])
    left, dropped = metrics["committed"], int(metrics["dropped"])
    valid = staged.filter(F.col(ROUTE) == "valid").select(*columns)
    errors = staged.filter(F.col(ROUTE) == "error").drop(ROUTE)
    routed = Routed(valid=valid, errors=errors, rows=sum(left.values()) + dropped,
                    error_rows=left.get("error", 0), path_frame=staged,
                    valid_bytes=int(metrics.get("valid_bytes") or 0),
                    dropped_rows=dropped, path=metrics["path"])
    return routed, metrics
