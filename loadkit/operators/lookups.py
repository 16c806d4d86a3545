"""Merge join and dimension lookups.

Broadcast is used only behind a proven size bound: ``fits_broadcast``
measures rows and bytes by one aggregate, unless the size estimate already
rules the side out.  Beyond the bound the lookup is an
ordinary shuffle join; AQE then splits skewed fact partitions
(``spark.sql.adaptive.skewJoin``), so a key holding a third of the fact
rows is spread over many tasks instead of one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadkit.functions.columns import CURRENT

# Largest side we ship to every executor: rows, and bytes of payload.
DEFAULT_BROADCAST_ROWS = 2_000_000
DEFAULT_BROADCAST_BYTES = 256 * 1024 * 1024

# A side that reads this many times the byte bound is taken to exceed it.
HOPELESS = 64

_HIT = "_lookup_hit"


class DuplicateLookupKey(ValueError):
    """The lookup side has more than one row for a key."""


# Bytes of a value of each fixed-width type.
_FIXED_SIZE = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4,
               T.DateType: 4, T.FloatType: 4, T.LongType: 8, T.DoubleType: 8,
               T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16}


def _fixed_size(t: T.DataType) -> int:
    for cls, size in _FIXED_SIZE.items():
        if isinstance(t, cls):
            return size
    return 16


def row_bytes(df: DataFrame) -> Column:
    """Payload bytes of a row: actual length of strings and binaries, JSON
    length of nested values, fixed size otherwise."""
    total = F.lit(16).cast("long")
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.StringType, T.BinaryType)):
            size = F.octet_length(c)
        elif isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
            size = F.octet_length(F.to_json(c))
        else:
            size = F.lit(_fixed_size(t))
        total = total + F.coalesce(size, F.lit(0)).cast("long")
    return total


def more_rows_than(df: DataFrame, n: int) -> bool:
    """True when ``df`` has more than ``n`` rows.

    ``offset(n).limit(1).collect()`` runs as an incremental take: Spark
    scans one partition, then ever larger batches, and stops as soon as row
    n + 1 exists; only zero-column rows move, and at most one reaches
    Python.  A side far above the bound costs a few partitions.
    """
    return len(df.select().offset(n).limit(1).collect()) > 0


def rows_at_most(df: DataFrame, n: int) -> bool:
    return not more_rows_than(df, n)


def estimated_bytes(df: DataFrame) -> int | None:
    """Size of what ``df`` reads, by the optimizer's statistics of its scans; None if one is unknown."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(n >= 1 << 62 for n in sizes) else sum(sizes)


def measured_size(df: DataFrame) -> tuple[int, int]:
    """(rows, payload bytes), by one aggregate."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(df)).alias("bytes")).first()
    return int(row["rows"]), int(row["bytes"] or 0)


def fits_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                   max_bytes: int = DEFAULT_BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes.

    A side that reads more than ``HOPELESS`` times the bound is not measured
    at all; any other is, by one aggregate of its rows and bytes.
    """
    if (estimated_bytes(df) or 0) > HOPELESS * max_bytes:
        return False
    return within_broadcast(measured_size(df), max_rows, max_bytes)


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "lookup side"
                  ) -> tuple[int, int]:
    """Raise when a key occurs twice; return (rows, bytes).

    One aggregate with a map-side combine: per-key counts and sizes, then
    their sums and the largest count, so the caller also learns the size
    of the side without another job.
    """
    stats = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(df)).alias("b"))
             .agg(F.sum("n").alias("rows"), F.max("n").alias("most"),
                  F.sum("b").alias("bytes")).first())
    if stats["most"] is not None and stats["most"] > 1:
        dup = df.groupBy(*keys).count().filter(F.col("count") > 1).limit(1).first()
        raise DuplicateLookupKey(f"{what} is not unique on {list(keys)}: {dup.asDict()}")
    return int(stats["rows"] or 0), int(stats["bytes"] or 0)


def within_broadcast(size: tuple[int, int], max_rows: int = DEFAULT_BROADCAST_ROWS,
                     max_bytes: int = DEFAULT_BROADCAST_BYTES) -> bool:
    """Whether a measured (rows, bytes) is within the broadcast bounds."""
    return size[0] <= max_rows and size[1] <= max_bytes


def _pairs(on: Sequence[str] | dict[str, str]) -> list[tuple[str, str]]:
    if isinstance(on, dict):
        return list(on.items())
    return [(k, k) for k in on]


def merge_join(detail: DataFrame, primary: DataFrame, on: Sequence[str] | str,
               how: str = "inner") -> DataFrame:
    """Detail rows joined to their primary row (equi-join on ``on``).

    No hint: both sides are large in a fact load, so the planner's
    sort-merge join (or AQE's runtime broadcast when one side turns out
    small) is the right call.
    """
    return detail.join(primary, on=on, how=how)


def _outputs(columns: Sequence[str] | dict[str, str]) -> dict[str, str]:
    """{dim column: output name}."""
    return dict(columns) if isinstance(columns, dict) else {c: c for c in columns}


def _lookup_side(dim: DataFrame, pairs: list[tuple[str, str]], columns, hit_column: str
                 ) -> tuple[DataFrame, dict[str, str]]:
    """The projected lookup side and the names of its keys in it."""
    key_alias = {dk: f"_lk_{i}" for i, (_, dk) in enumerate(pairs)}
    side = dim.select(*[F.col(dk).alias(key_alias[dk]) for _, dk in pairs],
                      *[F.col(c).alias(o) for c, o in _outputs(columns).items()],
                      F.lit(True).alias(hit_column))
    # A null dimension key can never match; drop it before counting keys.
    for alias in key_alias.values():
        side = side.filter(F.col(alias).isNotNull())
    return side, key_alias


def _measured_broadcast(side: DataFrame, keys: list[str], broadcast: bool | None, max_rows: int, max_bytes: int,
                        check_unique: bool, budget: list[int] | None) -> bool:
    """Check the keys if asked; ``broadcast`` as told, else by the side's size, which comes off the budget."""
    size = None
    if check_unique:
        size = assert_unique(side, keys, "lookup dimension")
    if broadcast is None:
        if budget is not None:
            max_bytes = min(max_bytes, budget[0])
        if size is None and (estimated_bytes(side) or 0) <= HOPELESS * max_bytes:
            size = measured_size(side)
        broadcast = size is not None and within_broadcast(size, max_rows, max_bytes)
        if broadcast and budget is not None:
            budget[0] -= size[1]
    return broadcast


def lookup_labelled(df: DataFrame, dim: DataFrame, on: Sequence[str] | dict[str, str],
                    columns: Sequence[str] | dict[str, str], *,
                    broadcast: bool | None = None,
                    max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
                    max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
                    check_unique: bool = True, budget: list[int] | None = None,
                    hit_column: str = _HIT) -> DataFrame:
    """Left join ``df`` to the projected ``dim``; adds ``columns`` and a hit flag.

    ``on``: key names shared by both sides, or {df column: dim column}.
    ``columns``: dim columns to return, or {dim column: output name}.
    ``broadcast``: True / False to force, None to decide by the measured
    size of the projected side (rows and bytes).
    ``budget``: one number, the bytes several lookups may broadcast together;
    a broadcast side's measured size is taken off it.
    A null key never matches.
    """
    pairs = _pairs(on)
    clash = {*_outputs(columns).values(), hit_column} & set(df.columns)
    if clash:
        raise ValueError(f"lookup output columns already exist: {sorted(clash)}")
    side, key_alias = _lookup_side(dim, pairs, columns, hit_column)
    if _measured_broadcast(side, list(key_alias.values()), broadcast, max_broadcast_rows, max_broadcast_bytes,
                           check_unique, budget):
        side = F.broadcast(side)
    cond = [df[fk] == side[key_alias[dk]] for fk, dk in pairs]
    joined = df.join(side, on=cond, how="left")
    return joined.drop(*key_alias.values()).withColumn(
        hit_column, F.coalesce(F.col(hit_column), F.lit(False)))


def lookup(df: DataFrame, dim: DataFrame, on, columns, **kw) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched).  Matched gains ``columns``; unmatched keeps the
    input columns only.  |matched| + |unmatched| = |df| (dim keys unique).
    """
    lab = lookup_labelled(df, dim, on, columns, hit_column=_HIT, **kw)
    matched = lab.filter(F.col(_HIT)).drop(_HIT)
    unmatched = lab.filter(~F.col(_HIT)).select(*df.columns)
    return matched, unmatched


def current_versions(dim: DataFrame, flag: str = "is_current") -> DataFrame:
    return dim.filter(F.col(flag) == F.lit(CURRENT))


def lookup_current(df: DataFrame, dim: DataFrame, on, columns, *, flag: str = "is_current",
                   **kw) -> tuple[DataFrame, DataFrame]:
    """Lookup against the current version of a type-2 dimension."""
    return lookup(df, current_versions(dim, flag), on, columns, **kw)


def multi_lookup(df: DataFrame, lookups: Sequence[dict], *, hit_prefix: str = "hit_"
                 ) -> DataFrame:
    """Chain several lookups; each adds its columns and ``hit_<name>``.

    ``lookups``: dicts with ``name``, ``dim``, ``on``, ``columns`` and optional
    ``current_only`` / ``broadcast``.  Broadcast lookups pipeline in one stage;
    together they ship ``DEFAULT_BROADCAST_BYTES`` at most, in the given order,
    the rest are shuffle joins.
    """
    out = df
    for spec in measured_lookups(lookups, hit_prefix=hit_prefix):
        out = lookup_labelled(out, _lookup_dim(spec), spec["on"], spec["columns"], broadcast=spec["broadcast"],
                              check_unique=False, hit_column=f"{hit_prefix}{spec['name']}")
    return out


def _lookup_dim(spec: dict) -> DataFrame:
    return current_versions(spec["dim"], spec.get("flag", "is_current")) if spec.get("current_only") else spec["dim"]


def measured_lookups(lookups: Sequence[dict], *, hit_prefix: str = "hit_") -> list[dict]:
    """The lookups with their keys checked and ``broadcast`` decided; measured once, nothing is left to measure."""
    budget, out = [DEFAULT_BROADCAST_BYTES], []
    for spec in lookups:
        side, key_alias = _lookup_side(_lookup_dim(spec), _pairs(spec["on"]), spec["columns"],
                                       f"{hit_prefix}{spec['name']}")
        broadcast = _measured_broadcast(side, list(key_alias.values()), spec.get("broadcast"),
                                        spec.get("max_broadcast_rows", DEFAULT_BROADCAST_ROWS),
                                        DEFAULT_BROADCAST_BYTES, spec.get("check_unique", True), budget)
        out.append({**spec, "broadcast": broadcast, "check_unique": False})
    return out


def join_with_lookups(detail: DataFrame, primary: DataFrame, on: Sequence[str] | str, lookups: Sequence[dict],
                      how: str = "inner", *, hit_prefix: str = "hit_") -> DataFrame:
    """``multi_lookup`` of an inner or left ``merge_join``: the same rows and columns.

    A lookup too large to broadcast shuffles the rows it is made for.  So it
    comes before the join if one input holds its keys: the rows are narrow
    there, and those of the primary fewer.  Broadcast lookups come after the
    join, where their columns are in no shuffle.
    """
    shared = {on} if isinstance(on, str) else set(on)
    own = {"primary": set(primary.columns), "detail": set(detail.columns)}
    before: dict[str, list[dict]] = {"primary": [], "detail": []}
    after, added = [], []
    measured = measured_lookups(lookups, hit_prefix=hit_prefix)
    for spec in measured:
        keys = {k for k, _ in _pairs(spec["on"])}
        new = [*_outputs(spec["columns"]).values(), f"{hit_prefix}{spec['name']}"]
        clear = not set(new) & (own["primary"] | own["detail"] | set(added))
        if not spec["broadcast"] and clear and keys <= own["primary"] - own["detail"]:
            before["primary"].append(spec)
        elif not spec["broadcast"] and clear and keys <= own["detail"] - (own["primary"] - shared):
            before["detail"].append(spec)
        else:
            after.append(spec)
        added += new
    joined = merge_join(multi_lookup(detail, before["detail"], hit_prefix=hit_prefix),
                        multi_lookup(primary, before["primary"], hit_prefix=hit_prefix), on=on, how=how)
    joined = multi_lookup(joined, after, hit_prefix=hit_prefix)
    if len(after) == len(measured):
        return joined
    # A detail row without a primary row (a left join) has missed the primary's lookups.
    missed = {h: F.coalesce(h, F.lit(False)) for h in (f"{hit_prefix}{spec['name']}" for spec in before["primary"])}
    return joined.withColumns(missed).select(*[c for c in joined.columns if c not in added], *added)


def all_hits(names: Sequence[str], hit_prefix: str = "hit_") -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{hit_prefix}{n}")
    return out
