"""Row-level projections, de-duplication, union and surrogate keys.

Every function maps DataFrame -> DataFrame and runs no action, except
``assign_surrogate_keys`` with an order (it stages the sorted ranges).
"""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadkit.functions.columns import date_key, file_name, ts_literal
from loadkit.operators.lookups import estimated_bytes


# --------------------------------------------------------------------------- PRJ1
def derived_columns(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add or replace columns in one projection.

    The expressions see the input columns only, not each other.
    """
    return df.withColumns(dict(columns))


# --------------------------------------------------------------------------- PRJ2
def lineage_columns(df: DataFrame, *, source_system: str | None = None,
                    load_ts: dt.datetime | str | None = None,
                    source_file: bool = False,
                    file_name_only: bool = False) -> DataFrame:
    """``load_timestamp`` always; ``source_system`` and ``source_file`` when asked.

    ``source_file`` is the file's full path (its last part with
    ``file_name_only``).  It comes from the scan's hidden ``_metadata`` column,
    so the frame must still be a direct file scan.
    """
    cols: dict[str, Column] = {"load_timestamp": ts_literal(load_ts)}
    if source_system is not None:
        cols["source_system"] = F.lit(source_system)
    if source_file:
        path = F.col("_metadata.file_path")
        cols["source_file"] = file_name(path) if file_name_only else path
    return df.withColumns(cols)


# --------------------------------------------------------------------------- PRJ4
def add_date_key(df: DataFrame, source: str, name: str = "date_sk") -> DataFrame:
    return df.withColumn(name, date_key(source))


# --------------------------------------------------------------------------- PRJ5
_PY_TYPES = {
    T.StringType: (str,),
    T.BooleanType: (bool,),
    T.DateType: (dt.date, str),
    T.TimestampType: (dt.datetime, str),
    T.TimestampNTZType: (dt.datetime, str),
}


def _default_fits(value, dtype: T.DataType) -> bool:
    if isinstance(dtype, T.NumericType):
        return isinstance(value, (int, float, decimal.Decimal)) and not isinstance(value, bool)
    for spark_t, py_t in _PY_TYPES.items():
        if isinstance(dtype, spark_t):
            return isinstance(value, py_t)
    return False


def null_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Replace nulls per column; a default of the wrong type raises here, not mid-job."""
    if not defaults:
        return df
    fields = {f.name: f.dataType for f in df.schema.fields}
    cols = {}
    for name, value in defaults.items():
        if name not in fields:
            raise KeyError(f"null default for unknown column {name!r}")
        if not _default_fits(value, fields[name]):
            raise TypeError(f"default {value!r} does not fit {name} {fields[name].simpleString()}")
        cols[name] = F.coalesce(F.col(name), F.lit(value).cast(fields[name]))
    return df.withColumns(cols)


# --------------------------------------------------------------------------- PRJ6
RAW_PREFIX = "_raw_"


def _convert(raw: Column, target: str, fmt: str | None) -> Column:
    if fmt and target.startswith("timestamp"):
        out = F.try_to_timestamp(raw, F.lit(fmt))
        return out.cast(target) if target != "timestamp" else out
    if fmt and target == "date":
        return F.try_to_date(raw, fmt)
    return raw.try_cast(target)


def type_conversions(df: DataFrame, spec: Mapping[str, str | tuple[str, str]]
                     ) -> tuple[DataFrame, list[dict]]:
    """Typed columns from string input, plus one error rule per converted column.

    ``spec``: column -> type, or (type, format) for dates and timestamps.
    Uses ``try_cast``: under ANSI a plain cast aborts the job on the first
    bad value, we want the row routed instead.  The raw text stays in
    ``_raw_<col>`` until ``drop_raw_columns`` so error rows can show it.
    Rule: raw value not null and converted value null -> ``bad_<col>``.
    """
    cols: dict[str, Column] = {}
    rules: list[dict] = []
    for name, target in spec.items():
        fmt = None
        if isinstance(target, tuple):
            target, fmt = target
        raw_name = RAW_PREFIX + name
        cols[raw_name] = F.col(name)
        cols[name] = _convert(F.col(name), target, fmt)
        rules.append({
            "name": f"bad_{name}",
            "condition": F.col(raw_name).isNotNull() & F.col(name).isNull(),
            "message": f"{name} is not a valid {target}",
        })
    return df.withColumns(cols), rules


def drop_raw_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(RAW_PREFIX)])


# --------------------------------------------------------------------------- SRT1
def _orderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return False
    if isinstance(dtype, T.ArrayType):
        return _orderable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_orderable(f.dataType) for f in dtype.fields)
    return True


def deduplicate(df: DataFrame, key_columns: Sequence[str], order_columns: Sequence[str],
                keep: str = "last") -> DataFrame:
    """One row per key: greatest (``last``) or least (``first``) ``order_columns``.

    Nulls rank lowest either way.  Ties are broken by every remaining
    orderable column so the choice repeats run to run.

    ``row_number() = 1`` runs with a partial ``WindowGroupLimit`` before the
    shuffle, so a hot key reaches the exchange as one row per map task.
    """
    if keep not in ("last", "first"):
        raise ValueError("keep must be 'last' or 'first'")
    keys = list(key_columns)
    used = set(keys) | set(order_columns)
    tie = [f.name for f in df.schema.fields if f.name not in used and _orderable(f.dataType)]
    ordering = [*order_columns, *tie]
    if keep == "last":
        sort = [F.col(c).desc_nulls_last() for c in ordering]
    else:
        sort = [F.col(c).asc_nulls_first() for c in ordering]
    w = Window.partitionBy(*keys).orderBy(*sort)
    rn = "_dedup_rn"
    return df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) == 1).drop(rn)


# --------------------------------------------------------------------------- SET1
def union_all(*frames: DataFrame) -> DataFrame:
    """UNION ALL by column name; a column missing from a frame becomes null.

    A column whose type differs between frames raises: silent widening to
    string would hide a bad source.
    """
    if not frames:
        raise ValueError("union_all needs at least one frame")
    seen: dict[str, T.DataType] = {}
    for f in frames:
        for field in f.schema.fields:
            prev = seen.setdefault(field.name, field.dataType)
            if prev != field.dataType:
                raise TypeError(f"column {field.name}: {prev.simpleString()} vs "
                                f"{field.dataType.simpleString()}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# --------------------------------------------------------------------------- PRJ3
_POS_MASK = (1 << 33) - 1
RANGE_BYTES = 128 * 1024 * 1024


def _ranges(df: DataFrame) -> int:
    """Ranges for a sort of ``df``: by the size of what it reads, at least the session's shuffle partitions."""
    size = estimated_bytes(df)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-(size or 0) // RANGE_BYTES))


def assign_surrogate_keys(df: DataFrame, key: str, *, order_by: Sequence[str] | None = None,
                          offset: int | Column = 0,
                          num_partitions: int | None = None) -> DataFrame:
    """Dense keys ``offset + 1 .. offset + n``.

    With ``order_by`` the key follows that (total) order: the frame is
    range-partitioned and sorted within partitions -- never one global task --
    and staged as parquet with each row's range and place in it, so the count
    and the numbering see the same rows even after a lost executor.
    Without ``order_by`` the frame must already be deterministic (e.g. a
    staged table read back) and numbering follows its partitions.

    Each range's first key is the sum of the row counts of the ranges before
    it: one row per range (bounded by the number of partitions, not the data),
    summed up in Spark and joined back as a broadcast table.
    """
    pid, pos, first, n = "_sk_pid", "_sk_pos", "_sk_first", "_sk_rows"

    def numbered(frame: DataFrame) -> DataFrame:
        return frame.withColumns({
            pid: F.spark_partition_id(),
            pos: F.monotonically_increasing_id().bitwiseAND(F.lit(_POS_MASK)),
        })

    if order_by:
        from loadkit.plans.staging import stage
        ranged = (df.repartitionByRange(num_partitions or _ranges(df), *order_by)
                  .sortWithinPartitions(*order_by))
        rows, _ = stage(numbered(ranged), "surrogate-ranges")
    else:
        rows = numbered(df)
    counts = rows.groupBy(pid).agg(F.count(F.lit(1)).alias(n))
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(pid, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    base = offset if isinstance(offset, Column) else F.lit(offset).cast("long")
    return (rows.join(F.broadcast(starts), on=pid, how="inner")
            .withColumn(key, base + F.col(first) + F.col(pos) + F.lit(1).cast("long"))
            .drop(pid, pos, first))
