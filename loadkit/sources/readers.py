"""Readers: partitioned JDBC, delimited and fixed-width files, stored tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadkit.functions.columns import date_literal

CORRUPT = "_corrupt_record"


# --------------------------------------------------------------------------- SRC1/2
def jdbc_options(url: str, table_or_query: str, *, partition_column: str | None = None,
                 lower_bound: int | None = None, upper_bound: int | None = None,
                 num_partitions: int | None = None, fetch_size: int | None = 10_000,
                 properties: Mapping[str, str] | None = None) -> dict[str, str]:
    """Options for a (partitioned) JDBC read.

    A query (text starting with SELECT) is wrapped as a derived table so it
    can still be read in parallel; the ``query`` option cannot.  Bounds set
    the stride only: rows outside them land in the first and last ranges.
    """
    src = table_or_query.strip()
    if src[:6].upper() == "SELECT" or src[:4].upper() == "WITH":
        src = f"({src}) loadkit_src"
    opts = {"url": url, "dbtable": src}
    parts = (partition_column, lower_bound, upper_bound, num_partitions)
    if any(p is not None for p in parts):
        if any(p is None for p in parts):
            raise ValueError("partitioned JDBC read needs column, bounds and partitions")
        opts.update(partitionColumn=partition_column, lowerBound=str(lower_bound),
                    upperBound=str(upper_bound), numPartitions=str(num_partitions))
    if fetch_size:
        opts["fetchsize"] = str(fetch_size)
    opts.update(properties or {})
    return opts


def read_jdbc(spark: SparkSession, url: str, table_or_query: str, **kw) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, table_or_query, **kw)).load()


# --------------------------------------------------------------------------- SRC4
def string_schema(columns: Sequence[str], corrupt: bool = True) -> T.StructType:
    fields = [T.StructField(c, T.StringType()) for c in columns]
    if corrupt:
        fields.append(T.StructField(CORRUPT, T.StringType()))
    return T.StructType(fields)


def read_delimited(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], *,
                   delimiter: str = ",", header: bool = True, encoding: str = "UTF-8",
                   keep_corrupt: bool = True, options: Mapping[str, str] | None = None
                   ) -> DataFrame:
    """Every column as string, named by ``columns``, never inferred.

    PERMISSIVE mode keeps short, long and unparsable lines as rows and puts
    the raw line into ``_corrupt_record`` so a rule can route them.  The
    check covers the columns a query reads (CSV column pruning), so route
    malformed lines on a plan that reads the whole row.
    """
    reader = (spark.read.schema(string_schema(columns, keep_corrupt))
              .option("sep", delimiter).option("header", str(header).lower())
              .option("encoding", encoding).option("mode", "PERMISSIVE")
              .option("enforceSchema", "true"))
    if keep_corrupt:
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    return reader.csv(path if isinstance(path, str) else list(path))


def corrupt_rule() -> dict:
    """Rule for malformed lines.  Spark rejects a query over the raw file
    that reads *only* the corrupt column (e.g. counting error rows alone);
    route and stage the whole row, as the loads do."""
    return {"name": "malformed_line", "condition": F.col(CORRUPT).isNotNull(),
            "message": "line does not match the file layout"}


# --------------------------------------------------------------------------- SRC5
def read_fixed_width(spark: SparkSession, path: str | Sequence[str],
                     fields: Sequence[tuple[str, int]], *, trim: bool = True,
                     encoding: str = "UTF-8", skip_pattern: str | None = None,
                     source_file: bool = False) -> DataFrame:
    """Fixed-width text: ``fields`` is an ordered list of (name, width).

    All strings (convert with ``type_conversions``).  A line shorter than the
    layout yields empty-then-null trailing fields; ``_record_length`` keeps
    the line length so a rule can reject wrong lengths.  Lines matching
    ``skip_pattern`` (a regex: header, trailer, comment lines) are dropped
    before parsing; lines carry no position once a file is split, so headers
    are recognised by content.  ``source_file`` adds the file's full path.
    """
    text = (spark.read.option("encoding", encoding).text(path))
    if skip_pattern:
        text = text.filter(~F.col("value").rlike(skip_pattern))
    line = F.col("value")
    cols = []
    pos = 1
    for name, width in fields:
        raw = F.substring(line, pos, width)
        v = F.rtrim(F.ltrim(raw)) if trim else raw
        cols.append(F.when(v == "", F.lit(None)).otherwise(v).alias(name))
        pos += width
    if source_file:
        cols.append(F.col("_metadata.file_path").alias("source_file"))
    return text.select(*cols, F.length(line).alias("_record_length"))


def fixed_width_length_rule(fields: Sequence[tuple[str, int]]) -> dict:
    total = sum(w for _, w in fields)
    return {"name": "bad_record_length", "condition": F.col("_record_length") != total,
            "message": f"record length differs from {total}"}


# --------------------------------------------------------------------------- SRC6
def read_table(spark: SparkSession, name_or_path: str, fmt: str = "parquet",
               columns: Sequence[str] | None = None) -> DataFrame:
    """A stored table by catalog name or path; projection prunes the scan."""
    if "/" in name_or_path or ":" in name_or_path:
        df = spark.read.format(fmt).load(name_or_path)
    else:
        df = spark.table(name_or_path)
    return df.select(*columns) if columns else df


# --------------------------------------------------------------------------- SRC3
def incremental_extract(df: DataFrame, modified_column: str, as_of: dt.date | str,
                        lookback_days: int = 3) -> DataFrame:
    """Rows modified on or after ``as_of - lookback_days`` (no upper bound).

    A plain comparison against a literal, so it reaches the parquet scan
    (``PushedFilters``) or the JDBC WHERE clause.
    """
    lower = F.date_sub(date_literal(as_of), lookback_days)
    col = F.col(modified_column)
    dtype = dict(df.dtypes)[modified_column]
    if dtype.startswith("timestamp"):
        lower = lower.cast(dtype)
    return df.filter(col >= lower)
