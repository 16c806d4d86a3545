"""What a load reads: one state of its source, with a count that retries cannot change.

Counts observed on a scan grow when a finished map task runs again, because
its output was lost with an executor.  So a load's read counts come from an
aggregate over files that do not change instead:

* A frame that is a plain read of files (it has ``_metadata``) lists its files
  once, when it is made, so a count and the load see the same rows.  For
  Parquet without a filter the count reads footers only.
* Any other frame (JDBC, joins, unions) may give other rows the next time.  It
  is written to the shared folder first, and the load goes on from there; its
  rows are counted in the footers of the committed files.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadkit.plans.steps import Steps
from loadkit.session import compressed, scratch_path

FILE = "_metadata.file_path"


@dataclass
class Read:
    """``frame``: what the load goes on from; ``files``: see ``rows_per_file``."""
    frame: DataFrame
    rows: int
    files: DataFrame
    staged: list[str] = field(default_factory=list)


def reads_files(df: DataFrame) -> bool:
    """Whether each row of ``df`` knows the file it comes from."""
    try:
        return len(df.select(FILE).columns) == 1
    except AnalysisException:
        return False


def rows_per_file(df: DataFrame, source: str, file: str = FILE) -> DataFrame:
    """(source, file_path, rows) of every file that ``df`` has rows of."""
    return (df.groupBy(F.col(file).alias("file_path")).agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit(source).alias("source"), "file_path", "rows"))


def counted_read(df: DataFrame, source: str, steps: Steps, *, step: str = "read",
                 snapshot: bool | None = None) -> Read:
    """``df`` as the load shall read it, with its exact count.

    ``snapshot``: write it to the shared folder first.  Unless told, that is
    done for frames that are no plain read of files; with False such a frame
    is run twice, for its count and for the load.  A snapshot has one row of
    ``files``, without a path.
    """
    spark, schema = df.sparkSession, df.schema
    if snapshot is None:
        snapshot = not reads_files(df)
    if not snapshot:
        rows = steps.once(step, lambda: {"rows": df.count()})["rows"]
        return Read(df, rows, rows_per_file(df, source) if reads_files(df) else _whole(df, source, rows))

    def run() -> dict:
        path = scratch_path(spark, f"read-{source}")
        compressed(spark, df.write.mode("error")).parquet(path)
        return {"rows": spark.read.schema(schema).parquet(path).count(), "path": path}

    left = steps.staged(step, schema.simpleString(), run)
    return Read(spark.read.schema(schema).parquet(left["path"]), left["rows"], _whole(df, source, left["rows"]),
                [left["path"]])


def _whole(df: DataFrame, source: str, rows: int) -> DataFrame:
    return df.sparkSession.range(1).select(F.lit(source).alias("source"), F.lit(None).cast("string").alias("file_path"),
                                           F.lit(rows).cast("long").alias("rows"))
