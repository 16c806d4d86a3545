"""Row routing: error rules, conditional split, error limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadkit.functions.columns import any_failed, failed_names, is_true

ERROR_RULES = "error_rules"
ERROR_MESSAGES = "error_messages"


class ErrorLimitExceeded(RuntimeError):
    """More bad rows than a load allows; nothing was published."""


def _check_rules(rules: Sequence[dict]) -> None:
    names = [r["name"] for r in rules]
    if len(set(names)) != len(names):
        raise ValueError(f"duplicate rule names: {names}")
    for r in rules:
        if not isinstance(r.get("condition"), Column):
            raise TypeError(f"rule {r.get('name')!r} needs a Column condition")


def tag_errors(df: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """Add ``error_rules`` / ``error_messages``: the rules a row fails, in rule order.

    A condition that is true marks an error; null counts as false.
    """
    _check_rules(rules)
    rules = [{**r, "message": r.get("message", r["name"])} for r in rules]
    failed, none = any_failed(rules), F.array().cast("array<string>")
    return df.withColumns({
        ERROR_RULES: F.when(failed, failed_names(rules, "name")).otherwise(none),
        ERROR_MESSAGES: F.when(failed, failed_names(rules, "message")).otherwise(none),
    })


def is_error_row() -> Column:
    return F.size(F.col(ERROR_RULES)) > 0


def route_errors(df: DataFrame, rules: Sequence[dict]) -> tuple[DataFrame, DataFrame]:
    """(valid, errors).  Valid keeps exactly the input columns; errors add the
    two arrays.  Every input row lands in exactly one output.  An empty rule
    list passes every row.

    The errors are filtered by the conditions themselves, which the scan can
    use; only error rows build the arrays.
    """
    _check_rules(rules)
    if not rules:
        empty = df.filter(F.lit(False)).withColumns({
            ERROR_RULES: F.array().cast("array<string>"),
            ERROR_MESSAGES: F.array().cast("array<string>"),
        })
        return df, empty
    failed = any_failed(rules)
    return df.filter(~is_true(failed)), tag_errors(df.filter(failed), rules)


# --------------------------------------------------------------------------- RTE1
def label_split(df: DataFrame, cases: Sequence[tuple[str, Column]], default: str = "default",
                label: str = "split_output") -> DataFrame:
    """Label each row with the first case whose condition is true, else ``default``."""
    if not cases:
        return df.withColumn(label, F.lit(default))
    expr = None
    for name, cond in cases:
        expr = (F.when(is_true(cond), F.lit(name)) if expr is None
                else expr.when(is_true(cond), F.lit(name)))
    return df.withColumn(label, expr.otherwise(F.lit(default)))


def conditional_split(df: DataFrame, cases: Sequence[tuple[str, Column]],
                      default: str = "default") -> dict[str, DataFrame]:
    """Named outputs; first true condition wins, the rest go to ``default``.

    Each output is a filter over one labelled projection; write them from a
    staged copy (``plans.staging``) when the input is expensive to recompute.
    """
    names = [n for n, _ in cases]
    if default in names or len(set(names)) != len(names):
        raise ValueError("output names must be unique and differ from the default")
    lab = "_split_label"
    labelled = label_split(df, cases, default, lab)
    return {n: labelled.filter(F.col(lab) == n).drop(lab) for n in [*names, default]}


# --------------------------------------------------------------------------- RTE3/4
def error_limit_status(errors: DataFrame, limit: int) -> DataFrame:
    """One row (error_limit, error_count, passed), computed by Spark."""
    return errors.agg(F.count(F.lit(1)).alias("error_count")).select(
        F.lit(limit).cast("long").alias("error_limit"),
        F.col("error_count"),
        (F.col("error_count") <= F.lit(limit)).alias("passed"),
    )


def enforce_error_limit(error_count: int, limit: int | None) -> None:
    """Fail when errors exceed the limit; the limit itself passes. ``None`` = no limit."""
    if limit is not None and error_count > limit:
        raise ErrorLimitExceeded(f"{error_count} error rows exceed the limit of {limit}")
