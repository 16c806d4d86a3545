"""The five load workflows: type-2 dimension, type-1 dimension, fact, flat file, generic.

Each composes the operators into one lazily-built plan, stages the routed
result once (``staging.route_and_stage``: counts, error limit and both
outputs from a single pass), then writes.  Nothing is published when the
error limit is exceeded.  Every workflow keeps an ``AuditTrail``.

With ``steps_path`` a load that failed and runs again under its batch id goes
on behind its last finished step (``plans.steps``): rows staged before are not
read from the source again.  A plain append that dies between its commit and
its entry is repeated; ``once=True`` closes that gap.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadkit.functions.columns import date_key
from loadkit.operators.lookups import (
    DEFAULT_BROADCAST_BYTES,
    DEFAULT_BROADCAST_ROWS,
    all_hits,
    join_with_lookups,
)
from loadkit.operators.routing import enforce_error_limit, tag_errors
from loadkit.operators.scd import scd1_merge, scd2_merge
from loadkit.operators.transforms import (
    assign_surrogate_keys,
    deduplicate,
    derived_columns,
    drop_raw_columns,
    lineage_columns,
    null_defaults,
    type_conversions,
)
from loadkit.plans.audit import AuditTrail
from loadkit.plans.reads import counted_read, rows_per_file
from loadkit.plans.staging import Routed, route_and_stage
from loadkit.plans.steps import Steps
from loadkit.session import path_exists
from loadkit.sinks.batches import append_batch, published, read_batches
from loadkit.sinks.buckets import BucketedTable
from loadkit.sinks.ledger import entry_names, read_entry, reserve_range
from loadkit.sinks.tables import append, publish_version, write_error_rows
from loadkit.sources.readers import (
    CORRUPT,
    corrupt_rule,
    fixed_width_length_rule,
    read_delimited,
    read_fixed_width,
)


@dataclass
class LoadResult:
    audit: AuditTrail
    output: DataFrame | None = None
    location: str | None = None
    metrics: dict = field(default_factory=dict)
    #: Staged tables under the shared folder; ``output`` never reads them, so they can go.
    staged: list[str] = field(default_factory=list)
    #: (source, file_path, rows) of the input files that had rows (``plans.reads``).
    read_files: DataFrame | None = None


EMPTY_SOURCE = "the source had no rows"
#: Names of the source system a load records unless told otherwise.
DIMENSION_SYSTEM, FACT_SYSTEM = "SOURCE_DB", "OLTP"


def _observation(label: str) -> Observation:
    """Observation names must be unique within a session."""
    return Observation(f"{label}_{uuid.uuid4().hex[:12]}")


def _limit(error_limit: int | None, error_fraction: float | None, rows: int) -> int | None:
    limits = []
    if error_limit is not None:
        limits.append(error_limit)
    if error_fraction is not None:
        limits.append(int(error_fraction * rows))
    return min(limits) if limits else None


def _finish_routing(routed: Routed, audit: AuditTrail, *, pipeline: str, stage: str,
                    error_path: str | None, error_limit: int | None,
                    error_fraction: float | None, load_ts, steps: Steps, total: int | None = None,
                    drop: Sequence[str] = (), once: bool = False) -> None:
    audit.record_errors(stage, routed.error_rows)
    rows = routed.rows if total is None else total
    enforce_error_limit(routed.error_rows, _limit(error_limit, error_fraction, rows))
    if error_path and routed.error_rows:
        def write() -> dict:
            write_error_rows(routed.errors.drop(*drop), error_path, pipeline, stage,
                             audit.batch_id, load_ts, once=once)
            return {"rows": routed.error_rows}

        steps.once("errors", write)


def _bounded(routed: Routed) -> bool:
    """The staged valid rows are small enough to broadcast (rows and bytes
    measured by the staging write itself)."""
    return (routed.valid_rows <= DEFAULT_BROADCAST_ROWS
            and routed.valid_bytes <= DEFAULT_BROADCAST_BYTES)


def _null_key_rule(keys: Sequence[str]) -> dict:
    cond = F.lit(False)
    for k in keys:
        cond = cond | F.col(k).isNull()
    return {"name": "null_key", "condition": cond, "message": "a key column is null"}


def _prepare_dimension_source(source: DataFrame, *, keys, order_columns, derived, defaults,
                              source_system, load_ts, rules, label, steps: Steps):
    """Null keys routed first (they skip the shuffle), then de-duplicate, then rules.

    Rejecting a bad latest row before de-duplication would load an older
    version of it, so the other rules run on the survivors.  A null-key row
    is tagged with every rule it fails.
    """
    df = lineage_columns(source, source_system=source_system, load_ts=load_ts)
    if derived:
        df = derived_columns(df, derived)
    if defaults:
        df = null_defaults(df, defaults)
    nk = _null_key_rule(keys)
    deduped = deduplicate(df.filter(~nk["condition"]), keys, order_columns, keep="last")
    null_keyed = tag_errors(df.filter(nk["condition"]), [nk, *rules])
    return route_and_stage(deduped, rules, label, pre_tagged=null_keyed, measure=True, steps=steps)[0]


def _run(spark: SparkSession, audit: AuditTrail, body: Callable[[Steps], LoadResult],
         audit_path: str | None, steps_path: str | None) -> LoadResult:
    """Run a load under its audit trail; append the trail to ``audit_path``
    whether the load completes or fails.  ``steps_path``: see ``plans.steps``."""
    audit.start()
    try:
        result = body(Steps(spark, steps_path, audit.batch_id, on_reuse=audit.record_reused))
    except Exception as e:
        audit.fail(f"{type(e).__name__}: {e}")
        if audit_path:
            audit.write(spark, audit_path)
        raise
    if audit_path:
        audit.write(spark, audit_path)
    return result


# --------------------------------------------------------------------------- PIP1
def _merge_dimension(spark: SparkSession, table: str | BucketedTable, root: str | None, source: DataFrame,
                     steps: Steps, merge: Callable[[DataFrame, DataFrame], DataFrame],
                     label: str) -> tuple[DataFrame, str, dict]:
    """Publish the next version of a dimension: (it read back, where it lies, what was written).

    A catalog table gets a whole new version folder; of a bucketed table only
    the buckets that hold a source key are read and written.
    """
    def run() -> dict:
        if isinstance(table, BucketedTable):
            written = table.merge(source, merge)
            return {"location": table.path, "written": {"buckets_written": len(written)}}
        obs = _observation(label)
        location = publish_version(spark, merge(spark.table(table), source), table, root, observation=obs)
        return {"location": location, "written": {"version_rows": obs.get["rows"]}}

    left = steps.once("publish", run)
    return _dimension(spark, table), left["location"], left["written"]


def _dimension(spark: SparkSession, table: str | BucketedTable) -> DataFrame:
    return table.read() if isinstance(table, BucketedTable) else spark.table(table)


def _dimension_name(table: str | BucketedTable) -> str:
    return table.path if isinstance(table, BucketedTable) else table


def load_dimension_scd2(spark: SparkSession, source: DataFrame, *, table: str | BucketedTable, root: str | None = None,
                        keys: Sequence[str], tracked: Sequence[str],
                        order_columns: Sequence[str], as_of: dt.date | str,
                        rules: Sequence[dict] = (), derived: Mapping[str, Column] | None = None,
                        defaults: Mapping[str, object] | None = None,
                        source_system: str = DIMENSION_SYSTEM, load_ts=None,
                        error_path: str | None = None, error_limit: int | None = None,
                        error_fraction: float | None = None,
                        audit: AuditTrail | None = None, snapshot: bool | None = None,
                        audit_path: str | None = None, steps_path: str | None = None) -> LoadResult:
    """Read -> exit if empty -> derive -> null defaults -> route null keys ->
    de-duplicate -> other rules -> SCD2 merge -> publish -> audit.

    ``table`` must exist (its current version is the merge target): a catalog
    table, of which ``root`` gets a whole new version, or a ``BucketedTable``,
    of which only the buckets that hold a source key are read and rewritten.
    ``snapshot``: see ``plans.reads.counted_read``.
    """
    audit = audit or AuditTrail("dimension_scd2")

    def body(steps: Steps) -> LoadResult:
        taken = counted_read(source, "source", steps, snapshot=snapshot)
        read = taken.rows
        audit.record_read("source", read)
        if not read:
            audit.complete(EMPTY_SOURCE)
            return LoadResult(audit, _dimension(spark, table), staged=taken.staged)
        routed = _prepare_dimension_source(
            taken.frame, keys=keys, order_columns=order_columns, derived=derived,
            defaults=defaults, source_system=source_system, load_ts=load_ts, rules=rules,
            label=f"{audit.pipeline}-route", steps=steps)
        dropped = read - routed.rows
        audit.record_dropped("dedup", dropped)
        _finish_routing(routed, audit, pipeline=audit.pipeline, stage="validation",
                        error_path=error_path, error_limit=error_limit,
                        error_fraction=error_fraction, load_ts=load_ts, steps=steps)
        out, location, written = _merge_dimension(
            spark, table, root, routed.valid, steps,
            lambda target, rows: scd2_merge(target, rows, keys, tracked, as_of, check_source_unique=False,
                                            broadcast_source=_bounded(routed)), "scd2")
        audit.record_write(_dimension_name(table), routed.valid_rows)
        audit.complete()
        return LoadResult(audit, out, location,
                          {"read": read, "dropped": dropped, "errors": routed.error_rows,
                           "valid": routed.valid_rows, **written}, [*taken.staged, routed.path], taken.files)

    return _run(spark, audit, body, audit_path, steps_path)


# --------------------------------------------------------------------------- PIP2
def load_dimension_scd1(spark: SparkSession, source: DataFrame, *, table: str | BucketedTable, root: str | None = None,
                        keys: Sequence[str], order_columns: Sequence[str],
                        exclude_columns: Sequence[str] = ("created_date",),
                        rules: Sequence[dict] = (), derived: Mapping[str, Column] | None = None,
                        source_system: str = DIMENSION_SYSTEM, load_ts=None,
                        error_path: str | None = None, error_limit: int | None = None,
                        error_fraction: float | None = None,
                        audit: AuditTrail | None = None, snapshot: bool | None = None,
                        audit_path: str | None = None, steps_path: str | None = None) -> LoadResult:
    """Read -> exit if empty -> derive -> route null keys -> de-duplicate -> rules -> SCD1 ->
    publish -> audit.  ``snapshot``: see ``plans.reads.counted_read``."""
    audit = audit or AuditTrail("dimension_scd1")

    def body(steps: Steps) -> LoadResult:
        taken = counted_read(source, "source", steps, snapshot=snapshot)
        read = taken.rows
        audit.record_read("source", read)
        if not read:
            audit.complete(EMPTY_SOURCE)
            return LoadResult(audit, _dimension(spark, table), staged=taken.staged)
        routed = _prepare_dimension_source(
            taken.frame, keys=keys, order_columns=order_columns, derived=derived, defaults=None,
            source_system=source_system, load_ts=load_ts, rules=rules,
            label=f"{audit.pipeline}-route", steps=steps)
        dropped = read - routed.rows
        audit.record_dropped("dedup", dropped)
        _finish_routing(routed, audit, pipeline=audit.pipeline, stage="validation",
                        error_path=error_path, error_limit=error_limit,
                        error_fraction=error_fraction, load_ts=load_ts, steps=steps)
        out, location, written = _merge_dimension(
            spark, table, root, routed.valid, steps,
            lambda target, rows: scd1_merge(target, rows, keys, exclude_columns, check_source_unique=False,
                                            broadcast_source=_bounded(routed)), "scd1")
        audit.record_write(_dimension_name(table), routed.valid_rows)
        audit.complete()
        return LoadResult(audit, out, location,
                          {"read": read, "dropped": dropped, "errors": routed.error_rows,
                           "valid": routed.valid_rows, **written}, [*taken.staged, routed.path], taken.files)

    return _run(spark, audit, body, audit_path, steps_path)


# --------------------------------------------------------------------------- PIP3
KEY_STATE, KEY_RANGES = "_key_state", "_key_ranges"
_KEY_SCHEMA = T.StructType([T.StructField("batch_id", T.StringType()), T.StructField("last_key", T.LongType())])


def _last_key(spark: SparkSession, path: str, key: str) -> int:
    """The last surrogate key given out for the table at ``path``.

    Asked once, for the first range of a table that has no ranges yet: from
    the state table earlier loads kept there, or by a scan of the target.
    """
    if path_exists(spark, f"{path}/{KEY_STATE}"):
        state = spark.read.schema(_KEY_SCHEMA).parquet(f"{path}/{KEY_STATE}")
        return int(state.agg(F.max("last_key")).first()[0] or 0)
    if not path_exists(spark, path):
        return 0
    try:
        target = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return 0  # no rows yet: another load's first range has made the folder
    return int(target.agg(F.max(key)).first()[0] or 0)


def _given_out(spark: SparkSession, path: str, key: str) -> int:
    """The last key given out: the end of the last range, or what a table without ranges says."""
    ranges = f"{path}/{KEY_RANGES}/ranges"
    taken = entry_names(spark, ranges)
    return int(read_entry(spark, f"{ranges}/{taken[-1]}")["end"]) if taken else _last_key(spark, path, key)


def reserve_keys(spark: SparkSession, path: str, run_id: str, key: str, count: int) -> int:
    """The key before the first of ``count`` keys that only this run gives out.

    Ranges are create-if-absent entries, so loads that reserve at once get
    ranges behind each other.  A range is recorded before its rows are
    written: a failed write leaves a gap, never a key given out twice.
    """
    return reserve_range(spark, f"{path}/{KEY_RANGES}", run_id, count, _given_out(spark, path, key))


def _reserve_keys(spark: SparkSession, path: str, batch_id: str, last_key: int, key: str = "fact_sk") -> None:
    """Give a batch all keys up to ``last_key`` that are left, whatever the rows hold; later loads go on after it."""
    count = last_key - _given_out(spark, path, key)
    if count > 0:
        reserve_keys(spark, path, batch_id, key, count)


def _read_target(spark: SparkSession, path: str, written: DataFrame) -> DataFrame:
    """The target read back; one that no batch has written to yet is an empty frame."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], written.schema)


def _append_valid(spark: SparkSession, valid: DataFrame, routed: Routed, path: str, steps: Steps,
                  partition_by: Sequence[str] | None, replace_partitions: bool = False,
                  batch_id: str | None = None) -> DataFrame:
    """Append the valid rows, if there are any, and read the target back; with ``batch_id`` as a published batch."""
    def write() -> dict:
        if batch_id is not None:
            append_batch(valid, path, batch_id, partition_by=partition_by)
        else:
            append(valid, path, partition_by=partition_by, replace_partitions=replace_partitions)
        return {"rows": routed.valid_rows}

    if routed.valid_rows:
        steps.once("write", write)
    return read_batches(spark, path, valid.schema) if batch_id is not None else _read_target(spark, path, valid)


def load_fact(spark: SparkSession, detail: DataFrame, primary: DataFrame, *,
              join_on: Sequence[str] | str, path: str, lookups: Sequence[dict] = (),
              date_column: str | None = None, derived: Mapping[str, Column] | None = None,
              rules: Sequence[dict] = (), key_column: str = "fact_sk",
              source_system: str = FACT_SYSTEM, load_ts=None, error_path: str | None = None,
              error_limit: int | None = None, error_fraction: float | None = None,
              replace_partitions: bool = False, partition_by: Sequence[str] | None = None, once: bool = False,
              snapshot: bool | None = None, audit: AuditTrail | None = None, audit_path: str | None = None,
              steps_path: str | None = None) -> LoadResult:
    """Two reads -> inner join -> dimension lookups -> derive (+ ``date_sk``) ->
    rules (a lookup miss is an error) -> surrogate key -> append partitioned
    by ``date_sk`` (or ``partition_by``; empty: not) -> audit.

    The join runs as a left join with a marker on the primary side; detail
    rows without a primary are counted by the staging write (in neither
    output, as in an inner join) and recorded as dropped.  Those with a null
    join key, which have none, are counted before the join and kept out of its
    shuffle, where they would meet in one task.  The two reads are
    counted by themselves (``plans.reads``; ``snapshot`` goes there), so
    neither a primary that repeats keys nor a task that runs again changes
    the detail count.  Surrogate keys continue from the last one given out
    for ``path``.  ``replace_partitions`` overwrites the date partitions the
    batch has rows for, so that a repeated batch does not double them.
    ``once``: the target is a table of published batches (``sinks.batches``);
    a load that is run again under its ``batch_id`` leaves each row once,
    with the keys reserved the first time.
    """
    audit = audit or AuditTrail("fact_load")

    def body(steps: Steps) -> LoadResult:
        marker = "_primary_hit"
        d, p = (counted_read(df, name, steps, step=f"read-{name}", snapshot=snapshot)
                for name, df in (("detail", detail), ("primary", primary)))
        read = {"detail": d.rows, "primary": p.rows}
        keyless = _null_key_rule([join_on] if isinstance(join_on, str) else join_on)["condition"]
        without_key = steps.once("null-keys", lambda: {"rows": d.frame.filter(keyless).count()})["rows"]
        joined = join_with_lookups(d.frame.filter(~keyless), p.frame.withColumn(marker, F.lit(True)), join_on, lookups,
                                   how="left")
        names = [spec["name"] for spec in lookups]
        cols: dict[str, Column] = dict(derived or {})
        if date_column:
            cols["date_sk"] = date_key(date_column)
        fact = lineage_columns(derived_columns(joined, cols), source_system=source_system,
                               load_ts=load_ts)
        miss = [{"name": f"missing_{n}", "condition": ~all_hits([n]),
                 "message": f"no {n} dimension row"} for n in names]
        routed, _ = route_and_stage(fact, [*miss, *rules], f"{audit.pipeline}-route",
                                    drop_when=F.col(marker).isNull(), steps=steps)
        joined_rows = routed.rows - routed.dropped_rows
        dropped = routed.dropped_rows + without_key
        for name, rows in read.items():
            audit.record_read(name, rows)
        audit.record_read("joined", joined_rows, stage="join")
        audit.record_dropped("join", dropped, "detail_without_primary")
        _finish_routing(routed, audit, pipeline=audit.pipeline, stage="validation",
                        error_path=error_path, error_limit=error_limit,
                        error_fraction=error_fraction, load_ts=load_ts, steps=steps, total=joined_rows,
                        drop=[marker], once=once)
        valid = routed.valid.drop(marker, *[f"hit_{n}" for n in names])
        offset = 0
        if routed.valid_rows and not (once and published(spark, path, audit.batch_id)):
            run_id = audit.batch_id if once or steps_path else f"{audit.batch_id}:{uuid.uuid4().hex}"
            offset = reserve_keys(spark, path, run_id, key_column, routed.valid_rows)
        keyed = assign_surrogate_keys(valid, key_column, offset=offset)
        parts = partition_by if partition_by is not None else ["date_sk"] if date_column else None
        out = _append_valid(spark, keyed, routed, path, steps, parts, replace_partitions, audit.batch_id if once else None)
        audit.record_write("fact_table", routed.valid_rows)
        audit.complete()
        return LoadResult(audit, out, path,
                          {**read, "joined": joined_rows, "dropped": dropped,
                           "errors": routed.error_rows, "written": routed.valid_rows},
                          [*d.staged, *p.staged, routed.path], d.files.unionByName(p.files))

    return _run(spark, audit, body, audit_path, steps_path)


# --------------------------------------------------------------------------- PIP4
def load_flat_file(spark: SparkSession, files: str | Sequence[str], columns: Sequence[str] = (), *,
                   path: str, conversions: Mapping[str, str | tuple[str, str]],
                   fixed_width: Sequence[tuple[str, int]] | None = None,
                   skip_pattern: str | None = None,
                   rules: Sequence[dict] = (), delimiter: str = ",", header: bool = True,
                   encoding: str = "UTF-8", load_ts=None, error_path: str | None = None,
                   error_limit: int | None = 50, error_fraction: float | None = None,
                   partition_by: Sequence[str] | None = None, once: bool = False, stop_early: bool = False,
                   audit: AuditTrail | None = None,
                   audit_path: str | None = None, steps_path: str | None = None) -> LoadResult:
    """Read (all strings) -> lineage -> convert -> rules (malformed lines,
    conversion failures, user rules) -> error limit -> append -> audit.

    Delimited files with ``columns``, or fixed-width ones with ``fixed_width``
    (name, width; ``skip_pattern`` drops header lines).  The default limit of
    50 bad rows is the file job's skip limit; pass ``error_limit=None`` and/or
    ``error_fraction`` to change it.  ``once``: as in ``load_fact``.
    ``stop_early``: cancel the staging write as soon as its tasks have met
    more bad rows than ``error_limit``, at the price of one boolean column
    that goes through Python.
    """
    audit = audit or AuditTrail("flat_file_ingest")

    def body(steps: Steps) -> LoadResult:
        if fixed_width:
            raw = read_fixed_width(spark, files, fixed_width, encoding=encoding, skip_pattern=skip_pattern,
                                   source_file=True)
            raw = lineage_columns(raw, load_ts=load_ts)
            layout, extra = fixed_width_length_rule(fixed_width), "_record_length"
        else:
            raw = read_delimited(spark, files, columns, delimiter=delimiter, header=header,
                                 encoding=encoding)
            raw = lineage_columns(raw, load_ts=load_ts, source_file=True)
            layout, extra = corrupt_rule(), CORRUPT
        conv, conv_rules = type_conversions(raw, conversions)
        routed, _ = route_and_stage(conv, [layout, *conv_rules, *rules], f"{audit.pipeline}-route", steps=steps,
                                    stop_over=error_limit if stop_early else None)
        audit.record_read("file", routed.rows)
        _finish_routing(routed, audit, pipeline=audit.pipeline, stage="validation",
                        error_path=error_path, error_limit=error_limit,
                        error_fraction=error_fraction, load_ts=load_ts, steps=steps, once=once)
        valid = drop_raw_columns(routed.valid).drop(extra)
        out = _append_valid(spark, valid, routed, path, steps, partition_by,
                            batch_id=audit.batch_id if once else None)
        audit.record_write("target", routed.valid_rows)
        audit.complete()
        return LoadResult(audit, out, path,
                          {"read": routed.rows, "errors": routed.error_rows,
                           "written": routed.valid_rows}, [routed.path],
                          rows_per_file(routed.path_frame, "file", "source_file"))

    return _run(spark, audit, body, audit_path, steps_path)


# --------------------------------------------------------------------------- PIP5
def load_generic(spark: SparkSession, source: DataFrame, *, path: str,
                 steps: Sequence[Callable[[DataFrame], DataFrame]] = (),
                 rules: Sequence[dict] = (), partition_by: Sequence[str] | None = None,
                 load_ts=None, error_path: str | None = None, error_limit: int | None = None,
                 error_fraction: float | None = None, once: bool = False, stop_early: bool = False,
                 audit: AuditTrail | None = None,
                 audit_path: str | None = None, steps_path: str | None = None) -> LoadResult:
    """User steps (``DataFrame.transform`` functions, in order) -> rules ->
    append -> audit.  ``once``: as in ``load_fact``; ``stop_early``: as in ``load_flat_file``."""
    audit = audit or AuditTrail("generic")

    def body(done: Steps) -> LoadResult:
        df = source
        for step in steps:
            df = df.transform(step)
        routed, _ = route_and_stage(df, rules, f"{audit.pipeline}-route", steps=done,
                                    stop_over=error_limit if stop_early else None)
        audit.record_read("source", routed.rows)
        _finish_routing(routed, audit, pipeline=audit.pipeline, stage="validation",
                        error_path=error_path, error_limit=error_limit,
                        error_fraction=error_fraction, load_ts=load_ts, steps=done, once=once)
        out = _append_valid(spark, routed.valid, routed, path, done, partition_by,
                            batch_id=audit.batch_id if once else None)
        audit.record_write("target", routed.valid_rows)
        audit.complete()
        return LoadResult(audit, out, path,
                          {"read": routed.rows, "errors": routed.error_rows,
                           "written": routed.valid_rows}, [routed.path])

    return _run(spark, audit, body, audit_path, steps_path)
