"""Slowly changing dimensions as DataFrame -> DataFrame functions.

Neither function writes: each returns the whole next version of the
dimension, which ``sinks.tables.publish_version`` writes to a new
directory and then points the table at.  Parquet has no MERGE, and
overwriting a path the plan still reads destroys it.

Scale notes.  SCD2 joins the source only to the *current* rows of the
target, which are unique per key, so the join cannot skew; closed history
rows never move (no shuffle, just a union).  SCD1 joins the whole target.
When the incoming batch has a proven size bound, the source is broadcast
and the target is never shuffled; otherwise one sort-merge full outer
join.  Both emit each output row from the joined row in one projection
(``inline`` of a 1- or 2-element array).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadkit.functions.columns import (
    CLOSED,
    CURRENT,
    OPEN_END_DATE,
    any_changed,
    date_literal,
)
from loadkit.operators.lookups import assert_unique, fits_broadcast, within_broadcast

EFFECTIVE = "effective_date"
END = "end_date"
FLAG = "is_current"


def _t(c: str) -> str:
    return f"_t_{c}"


def _s(c: str) -> str:
    return f"_s_{c}"


def _require(cols: Sequence[str], have: Sequence[str], what: str) -> None:
    missing = [c for c in cols if c not in have]
    if missing:
        raise KeyError(f"{what} lacks columns {missing}")


def _side(df: DataFrame, cols: Sequence[str], prefix, marker: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix(c)) for c in cols], F.lit(True).alias(marker))


def _full_join(target: DataFrame, tcols, source: DataFrame, scols, keys,
               broadcast_source: bool | None) -> DataFrame:
    """Target and source side by side, as a full outer join on the key.

    When the source has a proven size bound (``fits_broadcast``) the same
    shape is built without moving the target at all: target LEFT JOIN
    broadcast(source) gives every target row, and the source rows whose key
    the target lacks come from an anti join against the matched keys (a
    key-column-only scan of the target, semi-joined to the broadcast keys).
    Otherwise it is one sort-merge full outer join.
    """
    t = _side(target, tcols, _t, "_t_hit")
    s = _side(source, scols, _s, "_s_hit")
    if broadcast_source is None:
        broadcast_source = fits_broadcast(source)
    if not broadcast_source:
        cond = [t[_t(k)] == s[_s(k)] for k in keys]
        return t.join(s, on=cond, how="full_outer")
    bs = F.broadcast(s)
    with_target = t.join(bs, on=[t[_t(k)] == bs[_s(k)] for k in keys], how="left")
    skeys = F.broadcast(source.select(*[F.col(k).alias(_s(k)) for k in keys]))
    tkeys = target.select(*[F.col(k).alias(_t(k)) for k in keys])
    matched = tkeys.join(skeys, on=[tkeys[_t(k)] == skeys[_s(k)] for k in keys], how="left_semi")
    # Distinct: a target that repeats keys must not make this larger than the source.
    mk = F.broadcast(matched.distinct())
    only_source = s.join(mk, on=[s[_s(k)] == mk[_t(k)] for k in keys], how="left_anti")
    types = {f.name: f.dataType for f in t.schema.fields}
    only_source = only_source.select(
        *[F.lit(None).cast(types[_t(c)]).alias(_t(c)) for c in tcols],
        F.lit(None).cast("boolean").alias("_t_hit"), *[_s(c) for c in scols], "_s_hit")
    return with_target.unionByName(only_source)


def _null_key_guard(keys: Sequence[str]) -> Column:
    bad = F.lit(False)
    for k in keys:
        bad = bad | F.col(_s(k)).isNull()
    return bad


# --------------------------------------------------------------------------- SCD3
def change_detection(source: DataFrame, target: DataFrame, keys: Sequence[str],
                     tracked: Sequence[str], *, flag: str = FLAG,
                     current_only: bool = True, out: str = "change_type",
                     broadcast_target: bool | None = None) -> DataFrame:
    """Source rows labelled ``new`` / ``changed`` / ``unchanged`` against the
    current target version (null-safe: null <-> value is a change).

    The projected current rows are broadcast when they have a proven size
    bound, so the source is not shuffled; otherwise a sort-merge left join.
    """
    _require([*keys, *tracked], source.columns, "source")
    _require([*keys, *tracked], target.columns, "target")
    cur = target.filter(F.col(flag) == CURRENT) if current_only else target
    t = _side(cur, [*keys, *tracked], _t, "_t_hit")
    if broadcast_target is None:
        broadcast_target = fits_broadcast(t)
    if broadcast_target:
        t = F.broadcast(t)
    cond = [source[k] == t[_t(k)] for k in keys]
    j = source.join(t, on=cond, how="left")
    changed = any_changed((F.col(c), F.col(_t(c))) for c in tracked)
    label = (F.when(F.col("_t_hit").isNull(), F.lit("new"))
             .when(changed, F.lit("changed")).otherwise(F.lit("unchanged")))
    return j.select(*[source[c] for c in source.columns], label.alias(out))


# --------------------------------------------------------------------------- SCD2
def scd2_merge(target: DataFrame, source: DataFrame, keys: Sequence[str],
               tracked: Sequence[str], as_of: dt.date | str, *,
               effective: str = EFFECTIVE, end: str = END, flag: str = FLAG,
               check_source_unique: bool = True, check_target_unique: bool = True,
               broadcast_source: bool | None = None) -> DataFrame:
    """Next version of a type-2 dimension.

    * key only in target, or tracked columns unchanged: row kept as stored;
    * changed (any tracked column not null-safe equal): current row closed
      (``end = as_of``, ``flag = 0``) and a new current row opened;
    * key new, or with closed versions only: new current row
      (``effective = as_of``, ``end = 9999-12-31``, ``flag = 1``).
    Closed rows pass through.  ``as_of`` earlier than the current row's
    ``effective`` raises, as does a null key in the source, a key twice in
    the source, or two current rows for a key in the target.  Columns of the
    target that the source lacks carry over from the current version.

    The source is read more than once (checks, then the join); stage one
    that is dear to recompute.
    """
    meta = [effective, end, flag]
    tcols = target.columns
    _require([*keys, *meta, *tracked], tcols, "target")
    _require([*keys, *tracked], source.columns, "source")
    if check_source_unique:
        size = assert_unique(source, keys, "SCD2 source")
        if broadcast_source is None:
            broadcast_source = within_broadcast(size)
    attrs = [c for c in tcols if c not in keys and c not in meta]
    scols = [*keys, *[a for a in attrs if a in source.columns]]
    types = {f.name: f.dataType for f in target.schema.fields}

    current = target.filter(F.col(flag) == CURRENT)
    closed = target.filter(F.col(flag).isNull() | (F.col(flag) != CURRENT))
    if check_target_unique:
        assert_unique(current.select(*keys), keys, "current version of the SCD2 target")

    j = _full_join(current, tcols, source, scols, keys, broadcast_source)
    has_t = F.col("_t_hit").isNotNull()
    has_s = F.col("_s_hit").isNotNull()
    changed = has_t & has_s & any_changed((F.col(_t(c)), F.col(_s(c))) for c in tracked)
    as_of_c = date_literal(as_of)

    def kept(c: str) -> Column:
        if c == end:
            v = F.when(changed, as_of_c).otherwise(F.col(_t(c)))
        elif c == flag:
            v = F.when(changed, F.lit(CLOSED)).otherwise(F.col(_t(c)))
        elif c == effective:
            v = F.when(changed & (F.col(_t(c)) > as_of_c),
                       F.raise_error(F.lit("SCD2 as_of precedes the current effective date"))
                       ).otherwise(F.col(_t(c)))
        else:
            v = F.col(_t(c))
        return v.cast(types[c]).alias(c)

    def opened(c: str) -> Column:
        if c == effective:
            v = as_of_c
        elif c == end:
            v = F.lit(OPEN_END_DATE)
        elif c == flag:
            v = F.lit(CURRENT)
        elif c in keys:
            v = F.when(_null_key_guard(keys),
                       F.raise_error(F.lit("SCD2 source has a null business key"))
                       ).otherwise(F.col(_s(c)))
        elif c in scols:
            v = F.col(_s(c))
        else:
            v = F.col(_t(c))
        return v.cast(types[c]).alias(c)

    rows = F.array(F.when(has_t, F.struct(*[kept(c) for c in tcols])),
                   F.when(has_s & (~has_t | changed), F.struct(*[opened(c) for c in tcols])))
    merged = j.select(F.inline(F.filter(rows, lambda r: r.isNotNull())))
    return merged.unionByName(closed.select(*tcols))


# --------------------------------------------------------------------------- SCD1
def scd1_merge(target: DataFrame, source: DataFrame, keys: Sequence[str],
               exclude_columns: Sequence[str] = (), *,
               check_source_unique: bool = True,
               broadcast_source: bool | None = None) -> DataFrame:
    """Next version of a type-1 dimension (output has the target's schema).

    Matched keys: every non-key column the source has is overwritten, even
    by null, except ``exclude_columns``, which keep the stored value.
    New keys: inserted with all source columns, excluded ones included.
    Keys only in the target: untouched.  Source-only columns are not added.
    A null key in the source raises (route null keys first).
    """
    tcols = target.columns
    _require(keys, tcols, "target")
    _require(keys, source.columns, "source")
    if check_source_unique:
        size = assert_unique(source, keys, "SCD1 source")
        if broadcast_source is None:
            broadcast_source = within_broadcast(size)
    scols = [c for c in source.columns if c in tcols]
    types = {f.name: f.dataType for f in target.schema.fields}
    j = _full_join(target, tcols, source, scols, keys, broadcast_source)
    has_t = F.col("_t_hit").isNotNull()
    has_s = F.col("_s_hit").isNotNull()

    def pick(c: str) -> Column:
        if c in keys:
            v = (F.when(has_t, F.col(_t(c)))
                 .when(_null_key_guard(keys),
                       F.raise_error(F.lit("SCD1 source has a null business key")))
                 .otherwise(F.col(_s(c))))
        elif c not in scols:
            v = F.col(_t(c))
        elif c in exclude_columns:
            v = F.when(has_t, F.col(_t(c))).otherwise(F.col(_s(c)))
        else:
            v = F.when(has_s, F.col(_s(c))).otherwise(F.col(_t(c)))
        return v.cast(types[c]).alias(c)

    return j.select(*[pick(c) for c in tcols])
