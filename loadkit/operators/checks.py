"""Data-quality checks.  Each returns a report frame; none collects data rows.

Reports that describe columns are built from a one-row aggregate with
``inline``, so each check is a single pass over the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadkit.operators.lookups import DEFAULT_BROADCAST_ROWS, fits_broadcast


# --------------------------------------------------------------------------- VAL1
def schema_check(df: DataFrame, expected: T.StructType) -> DataFrame:
    """(column_name, expected_type, actual_type, status, bad_rows).

    status: ``ok``, ``type_mismatch``, ``missing``, ``unexpected``.
    bad_rows: for a mismatched column, non-null values that do not convert
    to the expected type (``try_cast``); 0 for ``ok``; null otherwise.
    """
    actual = {f.name: f.dataType for f in df.schema.fields}
    rows = []  # (name, expected, actual, status, bad expr or None)
    aggs = []
    for f in expected.fields:
        if f.name not in actual:
            rows.append((f.name, f.dataType.simpleString(), None, "missing", None))
        elif actual[f.name] == f.dataType:
            rows.append((f.name, f.dataType.simpleString(), actual[f.name].simpleString(), "ok", 0))
        else:
            alias = f"_bad_{len(aggs)}"
            c = F.col(f.name)
            aggs.append(F.count_if(c.isNotNull() & c.try_cast(f.dataType).isNull()).alias(alias))
            rows.append((f.name, f.dataType.simpleString(), actual[f.name].simpleString(),
                         "type_mismatch", alias))
    names = {f.name for f in expected.fields}
    for f in df.schema.fields:
        if f.name not in names:
            rows.append((f.name, None, f.dataType.simpleString(), "unexpected", None))
    base = df.agg(*aggs) if aggs else df.sparkSession.range(1)

    def bad(v):
        if v is None:
            return F.lit(None).cast("long")
        return F.col(v).cast("long") if isinstance(v, str) else F.lit(v).cast("long")

    structs = [F.struct(F.lit(n).alias("column_name"),
                        F.lit(e).cast("string").alias("expected_type"),
                        F.lit(a).cast("string").alias("actual_type"),
                        F.lit(s).alias("status"),
                        bad(b).alias("bad_rows"))
               for n, e, a, s, b in rows]
    return base.select(F.inline(F.array(*structs)))


# --------------------------------------------------------------------------- VAL2
def null_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, row_count, null_count, passed) for each required column."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(columns)]
    structs = [F.struct(F.lit(c).alias("column_name"),
                        F.col("_rows").alias("row_count"),
                        F.col(f"_n{i}").alias("null_count"),
                        (F.col(f"_n{i}") == 0).alias("passed"))
               for i, c in enumerate(columns)]
    return df.agg(*aggs).select(F.inline(F.array(*structs)))


# --------------------------------------------------------------------------- VAL3
def duplicate_check(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys occurring more than once, with their count (``dup_count``).

    Counting aggregates map-side first, so a hot key is one row per task
    before the shuffle.
    """
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("dup_count"))
            .filter(F.col("dup_count") > 1))


# --------------------------------------------------------------------------- VAL4
def ref_integrity_check(child: DataFrame, parent: DataFrame,
                        on: Sequence[str] | dict[str, str], *,
                        broadcast: bool | None = None,
                        max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Child rows whose key has no parent row (null keys included: they have none).

    ``on``: shared names or {child column: parent column}.  A left-anti join
    against the parent's distinct keys.  When those keys have a proven size
    bound they are broadcast and the child (usually the large side) is not
    shuffled; otherwise a sort-merge anti join, where AQE splits a skewed
    child partition.
    """
    pairs = list(on.items()) if isinstance(on, dict) else [(k, k) for k in on]
    keys = parent.select(*[F.col(p).alias(f"_rk_{i}") for i, (_, p) in enumerate(pairs)]).distinct()
    if broadcast is None:
        broadcast = fits_broadcast(keys, max_broadcast_rows)
    if broadcast:
        keys = F.broadcast(keys)
    cond = [child[c] == keys[f"_rk_{i}"] for i, (c, _) in enumerate(pairs)]
    return child.join(keys, on=cond, how="left_anti")
