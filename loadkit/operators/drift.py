"""Schema drift between the files of one table or feed.

Spark reads a folder with one merged or declared schema, so a file that lost a
column gives nulls, and a CSV file whose columns changed places gives wrong
values, without a word.  ``schema_drift`` reads every file's footer (Parquet)
or header line (CSV) in tasks and names the files that differ.

Files are listed by Spark and opened by path in the workers, through Arrow's
file systems (local and mounted folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

LAYOUT = "file_path string, file_rows long, position int, column_name string, type string, readable boolean"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or path, and the path there."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote("/" + path[len("file:"):].lstrip("/"))
    if ":/" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def spark_type(field: pa.Field, int96: bool) -> str:
    """The type Spark reads a column as; Arrow's own name where Spark has none."""
    if int96:
        return "timestamp"
    try:
        return from_arrow_type(field.type, prefer_timestamp_ntz=True).simpleString()
    except PySparkException:
        return str(field.type)


def parquet_columns(path: str) -> tuple[int | None, list[tuple[str, str | None]]]:
    """(rows, [(name, type)]) from the footer of ``path``."""
    system, name = opened(path)
    with system.open_input_file(name) as f:
        file = pq.ParquetFile(f)
        leaves = (file.schema.column(i) for i in range(len(file.schema)))
        int96 = {leaf.path for leaf in leaves if leaf.physical_type == "INT96"}
        return file.metadata.num_rows, [(c.name, spark_type(c, c.name in int96)) for c in file.schema_arrow]


def csv_columns(path: str, delimiter: str, encoding: str) -> tuple[int | None, list[tuple[str, str | None]]]:
    """(None, [(name, None)]) from the first record of ``path``, compressed or not; quoted names may hold line ends."""
    system, name = opened(path)
    with system.open_input_stream(name) as f, io.TextIOWrapper(f, encoding=encoding, newline="") as lines:
        return None, [(c, None) for c in next(csv.reader(lines, delimiter=delimiter), [])]


def file_layouts(spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet",
                 options: Mapping[str, str] | None = None) -> DataFrame:
    """One row per file and column, and one for a file without columns (``column_name`` null).

    A file whose footer or header cannot be read is not ``readable``.  Only
    the names of the files go through Spark; no data page is read.
    """
    options = dict(options or {})
    delimiter, encoding = options.get("sep", ","), options.get("encoding", "utf-8")
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"no layout to read from {fmt} files")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file in frame["path"]:
                try:
                    n, columns = parquet_columns(file) if fmt == "parquet" else csv_columns(file, delimiter, encoding)
                    readable = True
                except (pa.ArrowInvalid, UnicodeDecodeError, csv.Error):
                    n, columns, readable = None, [], False
                rows += [(file, n, i, c, t, readable) for i, (c, t) in enumerate(columns or [(None, None)])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LAYOUT.split(", ")]).astype(
                {"file_rows": "Int64", "position": "Int32", "column_name": object, "type": object})

    files = (spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path)).select("path"))
    return files.mapInPandas(read, LAYOUT)


def expected_layout(layouts: DataFrame) -> DataFrame:
    """(column_name, expected_type, expected_position) that most files agree on.

    A column is expected if at least half of the readable files have it, with
    its commonest type and then place; ties go to the lesser.
    """
    total = layouts.filter("readable").agg(F.count_distinct("file_path").alias("files"))
    voted = (layouts.filter(F.col("column_name").isNotNull()).groupBy("column_name", "type", "position")
             .agg(F.count(F.lit(1)).alias("votes")))
    # Few rows: one for each name, type and place met.  The votes for a type are those of all its places.
    of_type, of_name = Window.partitionBy("column_name", "type"), Window.partitionBy("column_name")
    ranked = voted.select(
        "*", F.sum("votes").over(of_type).alias("type_votes"), F.sum("votes").over(of_name).alias("files_with"))
    first = Window.partitionBy("column_name").orderBy(
        F.desc("type_votes"), F.asc("type"), F.desc("votes"), F.asc("position"))
    return (ranked.withColumn("place", F.row_number().over(first)).filter("place = 1")
            .filter(2 * F.col("files_with") >= total.scalar())
            .select("column_name", F.col("type").alias("expected_type"), F.col("position").alias("expected_position")))


def schema_drift(spark: SparkSession, path: str | Sequence[str], expected: T.StructType | None = None, *,
                 fmt: str = "parquet", options: Mapping[str, str] | None = None) -> DataFrame:
    """(file_path, file_rows, column_name, expected_type, file_type, status), one row for each difference of a file.

    status: ``missing`` (an expected column the file lacks), ``type_differs``,
    ``unexpected`` (a column that is not expected), ``moved`` (CSV, which is
    read by position: the column is elsewhere), ``unreadable`` (the file is
    broken; ``column_name`` null).  Files like the expected layout give no
    row, nor do files of no bytes, which Spark skips in any read.  ``expected`` is the schema to hold the
    files against; unless given, what most files agree on.  CSV columns have
    no types.  ``file_rows`` is null for CSV.  Names differ by case only if
    the session says so.
    """
    layouts = file_layouts(spark, path, fmt, options)
    if spark.conf.get("spark.sql.caseSensitive", "false") == "false":
        layouts = layouts.withColumn("column_name", F.lower("column_name"))
        named = [(f.name.lower(), f) for f in expected.fields] if expected is not None else []
    else:
        named = [(f.name, f) for f in expected.fields] if expected is not None else []
    if expected is None:
        wanted = expected_layout(layouts)
    else:
        wanted = spark.createDataFrame(
            [(n, f.dataType.simpleString() if fmt == "parquet" else None, i) for i, (n, f) in enumerate(named)],
            "column_name string, expected_type string, expected_position int")
    # A file's columns become one row, and the expected ones (as many as the table has) one value beside it.
    per_file = layouts.groupBy("file_path").agg(
        F.max("file_rows").alias("file_rows"), F.min("readable").alias("readable"),
        F.collect_list(F.when(F.col("column_name").isNotNull(), F.struct(
            "column_name", F.col("type").alias("file_type"), "position"))).alias("has"))
    all_wanted = wanted.agg(F.collect_list(F.struct(*wanted.columns)).alias("wants"))
    both = per_file.withColumn("wants", all_wanted.scalar())

    def difference(name, expected_type, file_type, status):
        return F.struct(name.alias("column_name"), expected_type.cast("string").alias("expected_type"),
                        file_type.cast("string").alias("file_type"), status.alias("status"))

    def own(w):
        return F.get(F.filter("has", lambda h: h["column_name"] == w["column_name"]), 0)

    def of_wanted(w):
        h, nothing = own(w), F.lit(None)
        moved = h["position"] != w["expected_position"] if fmt == "csv" else F.lit(False)
        status = (F.when(h.isNull(), F.lit("missing"))
                  .when(~h["file_type"].eqNullSafe(w["expected_type"]), F.lit("type_differs"))
                  .when(moved, F.lit("moved")).otherwise(nothing))
        return difference(w["column_name"], w["expected_type"], h["file_type"], status)

    def of_others(h):
        return difference(h["column_name"], F.lit(None), h["file_type"], F.lit("unexpected"))

    others = F.filter("has", lambda h: ~F.exists("wants", lambda w: w["column_name"] == h["column_name"]))
    found = F.concat(F.filter(F.transform("wants", of_wanted), lambda d: d["status"].isNotNull()),
                     F.transform(others, of_others))
    null = F.lit(None)
    broken = F.array(difference(null.cast("string"), null, null, F.lit("unreadable")))
    return (both.select("file_path", "file_rows", F.explode(F.when(F.col("readable"), found).otherwise(broken)).alias("d"))
            .select("file_path", "file_rows", "d.*"))
