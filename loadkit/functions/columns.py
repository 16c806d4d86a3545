"""Column expressions shared by the operators, from built-in functions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the dimension contract: open-ended validity and flag values.
OPEN_END_DATE = dt.date(9999, 12, 31)
CURRENT = 1
CLOSED = 0


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def date_key(c: str | Column) -> Column:
    """``yyyyMMdd`` as an int, by arithmetic instead of string formatting."""
    c = as_column(c)
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("int")


def ts_literal(value: dt.datetime | str | None) -> Column:
    """A load timestamp: the given value, or the current local time.

    Always ``timestamp_ntz``, the type the source tables carry.
    """
    if value is None:
        return F.localtimestamp()
    if isinstance(value, dt.datetime):
        value = value.isoformat(sep=" ")
    return F.to_timestamp_ntz(F.lit(value))


def date_literal(value: dt.date | str) -> Column:
    if isinstance(value, dt.datetime):
        value = value.date()
    if isinstance(value, dt.date):
        value = value.isoformat()
    return F.to_date(F.lit(value))


def not_equal_null_safe(left: Column, right: Column) -> Column:
    return ~left.eqNullSafe(right)


def any_changed(pairs: Iterable[tuple[Column, Column]]) -> Column:
    """True when any pair differs, null-safe (null -> value counts as a change)."""
    out = F.lit(False)
    for a, b in pairs:
        out = out | not_equal_null_safe(a, b)
    return out


def is_true(cond: Column) -> Column:
    """Null-as-false reading of a rule condition."""
    return F.coalesce(cond, F.lit(False))


def failed_names(rules: Sequence[dict], field: str = "name") -> Column:
    """``array<string>`` of the rule ``field`` for every rule whose condition holds."""
    none = F.array().cast("array<string>")
    if not rules:
        return none
    return F.concat(*[F.when(r["condition"], F.array(F.lit(r[field]))).otherwise(none) for r in rules])


def any_failed(rules: Sequence[dict]) -> Column:
    """Whether a rule's condition holds: null or true.

    A plain OR, so that a filter on it can reach the scan; wrap it in
    ``is_true`` to negate it.
    """
    out = F.lit(False)
    for r in rules:
        out = out | r["condition"]
    return out


def file_name(path_col: Column) -> Column:
    """Last path segment of a file URI."""
    return F.regexp_extract(path_col, r"([^/]+)$", 1)
