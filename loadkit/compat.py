"""The call names a generated load job uses, mapped onto loadkit.

A job written against those names runs unchanged by importing them from
here.  Each function only adapts arguments and delegates; the work is in
the operators.  Where such a call names no folder, it is the one in the
session setting ``spark.loadkit.root``, or ``tables`` in the shared folder.

Fixed values: the names and argument names below are the interface such
jobs call, kept as they are so existing jobs need no edits.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from loadkit.operators import checks, lookups, routing, scd, transforms
from loadkit.plans.audit import AuditTrail
from loadkit.session import shared_dir
from loadkit.sinks import tables as sinks
from loadkit.sources import readers


ROOT_SETTING = "spark.loadkit.root"


def table_root(spark: SparkSession) -> str:
    """Folder of the published tables and error rows."""
    return (spark.conf.get(ROOT_SETTING, None) or f"{shared_dir(spark)}/tables").rstrip("/")


def get_jdbc_connection(spark: SparkSession, conn: Mapping[str, str], table_or_query: str,
                        num_partitions: int | None = None, partition_column: str | None = None,
                        lower_bound: int | None = None, upper_bound: int | None = None
                        ) -> DataFrame:
    """``conn``: ``url`` plus driver properties (``user``, ``password``, ``driver``)."""
    props = {k: v for k, v in conn.items() if k != "url"}
    return readers.read_jdbc(spark, conn["url"], table_or_query, partition_column=partition_column,
                             lower_bound=lower_bound, upper_bound=upper_bound,
                             num_partitions=num_partitions, properties=props)


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True,
             encoding: str = "UTF-8", columns: Sequence[str] | None = None) -> DataFrame:
    """Every column as string.  Names come from ``columns`` or the header line."""
    if columns is None:
        if not header:
            raise ValueError("read_csv needs column names when the file has no header")
        columns = (spark.read.option("header", "true").option("sep", delimiter)
                   .option("encoding", encoding).csv(path).columns)
    return readers.read_delimited(spark, path, columns, delimiter=delimiter, header=header,
                                  encoding=encoding)


def apply_derived_columns(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    return transforms.derived_columns(df, columns)


def apply_null_handling(df: DataFrame, defaults: Mapping[str, object] | None = None) -> DataFrame:
    return transforms.null_defaults(df, defaults or {})


def apply_type_conversions(df: DataFrame, conversions: Mapping[str, str | tuple[str, str]]
                           ) -> DataFrame:
    """Typed columns; values that do not convert become null (see
    ``transforms.type_conversions`` for the matching error rules)."""
    converted, _ = transforms.type_conversions(df, conversions)
    return transforms.drop_raw_columns(converted)


def apply_conditional_split(df: DataFrame, cases: Sequence[tuple[str, Column]],
                            default: str = "default") -> dict[str, DataFrame]:
    return routing.conditional_split(df, cases, default)


def apply_lookup(df: DataFrame, dim: DataFrame, on, columns, **kw) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched); broadcast when the dimension's size is proven small."""
    return lookups.lookup(df, dim, on, columns, **kw)


def union_dataframes(*frames: DataFrame) -> DataFrame:
    return transforms.union_all(*frames)


def deduplicate(df: DataFrame, key_columns: Sequence[str], order_columns: Sequence[str],
                keep: str = "last") -> DataFrame:
    return transforms.deduplicate(df, key_columns, order_columns, keep)


def route_errors(df: DataFrame, rules: Sequence[dict]) -> tuple[DataFrame, DataFrame]:
    return routing.route_errors(df, rules)


def write_error_rows(df_errors: DataFrame, pipeline_name: str, stage: str, batch_id: str, *,
                     path: str | None = None) -> None:
    sinks.write_error_rows(df_errors, path or f"{table_root(df_errors.sparkSession)}/error_rows",
                           pipeline_name, stage, batch_id)


def write_delta(df: DataFrame, path: str, mode: str = "append",
                partition_by: Sequence[str] | None = None, fmt: str = "parquet") -> None:
    """Append; ``mode="overwrite"`` replaces the written partitions, or all
    of an unpartitioned table."""
    if mode not in ("append", "overwrite"):
        raise ValueError("mode must be 'append' or 'overwrite'")
    if mode == "overwrite" and not partition_by:
        sinks.replace(df, path, fmt=fmt)
    else:
        sinks.append(df, path, fmt=fmt, partition_by=partition_by,
                     replace_partitions=(mode == "overwrite"))


def write_jdbc(df: DataFrame, conn: Mapping[str, str], table: str, mode: str = "append",
               batch_size: int = 1000) -> None:
    props = {k: v for k, v in conn.items() if k != "url"}
    sinks.write_jdbc(df, conn["url"], table, mode=mode, batch_size=batch_size, properties=props)


def validate_schema(df: DataFrame, expected) -> DataFrame:
    return checks.schema_check(df, expected)


def check_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return checks.null_check(df, columns)


def check_duplicates(df: DataFrame, key_columns: Sequence[str]) -> DataFrame:
    return checks.duplicate_check(df, key_columns)


def scd_type2_merge(spark: SparkSession, df: DataFrame, target_table: str,
                    business_keys: Sequence[str], tracked_columns: Sequence[str], *,
                    root: str | None = None, as_of: dt.date | None = None) -> str:
    """Merge into catalog table ``target_table`` and publish a new version under ``root``."""
    merged = scd.scd2_merge(spark.table(target_table), df, business_keys, tracked_columns,
                            as_of or dt.date.today())
    return sinks.publish_version(spark, merged, target_table, root or table_root(spark))


def scd_type1_merge(spark: SparkSession, df: DataFrame, target_table: str,
                    business_keys: Sequence[str], exclude_columns: Sequence[str] = (), *,
                    root: str | None = None) -> str:
    merged = scd.scd1_merge(spark.table(target_table), df, business_keys, exclude_columns)
    return sinks.publish_version(spark, merged, target_table, root or table_root(spark))


class AuditTracker(AuditTrail):
    """Run record with ``record_read`` / ``record_errors`` / ``record_write`` /
    ``complete`` / ``fail``; ``environment`` is kept in the message of the start row."""

    def __init__(self, pipeline_name: str, environment: str = "dev", **kw):
        super().__init__(pipeline_name, **kw)
        self.environment = environment

    def start(self) -> None:
        super().start()
        self.records[-1] = (*self.records[-1][:9], f"environment={self.environment}")

