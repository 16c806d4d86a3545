"""Extracts that know how far the last one came (SRC3 with state).

The state of a source is a chain of marks, create-if-absent entries
``<state>/<source>/marks/<n>``: the latest modified time delivered so far, and
a folder with the (key, modified) pairs delivered within the look-back before
it.  An extract reads from that time less the look-back, a plain comparison
that reaches the scan, and leaves out the pairs delivered before by an anti
join.  So rows that arrive late, but within the look-back, are delivered, and
no version is delivered by two extracts.

The extract is staged first: the rows handed out, the next mark and its pairs
all come from that one read of a source that may change meanwhile.  Nothing
moves until ``commit``: a load that fails gets its rows again.  Of two extracts
from one mark only the first to commit may do so.

Rows without a modified time are no version and are never delivered, nor are
those that arrive later than the look-back.  Rows of one extract that repeat a
pair are all delivered; null keys are equal to each other.  Pairs kept are
those of the look-back only, however long the history.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadkit.plans.staging import stage
from loadkit.sinks.ledger import create_entry, entry_names, key_name, read_entry

#: By type of the modified column: how a mark writes a time, how it reads it, and a time some days before. None of it
#: depends on the session's time zone.
MARK_TIMES = {
    "date": (F.unix_date, lambda v: F.date_from_unix_date(F.lit(v)), F.date_sub),
    "timestamp": (F.unix_micros, lambda v: F.timestamp_micros(F.lit(v).cast("long")),
                  lambda t, days: t - F.make_dt_interval(F.lit(days))),
    "timestamp_ntz": (lambda c: c.cast("string"), lambda v: F.lit(v).cast("timestamp_ntz"),
                      lambda t, days: t - F.make_dt_interval(F.lit(days))),
}


class MarkConflict(RuntimeError):
    """Another extract of the source was committed since this one was read."""


@dataclass
class Extract:
    """``rows``: what is new, staged at ``path``; ``mark``: the state's next entry, which ``commit`` creates."""

    rows: DataFrame
    count: int
    path: str
    number: int
    folder: str
    mark: dict | None

    def commit(self) -> None:
        """Take the rows as delivered.  An extract without rows leaves the state as it is."""
        if self.mark and not create_entry(self.rows.sparkSession, f"{self.folder}/{self.number:018d}", self.mark):
            raise MarkConflict(f"mark {self.number} of {self.mark['source']} exists")


def last_mark(spark: SparkSession, folder: str) -> tuple[int, dict | None]:
    """(number of the next mark, the last one or None)."""
    taken = entry_names(spark, folder)
    return (int(taken[-1]) + 1, read_entry(spark, f"{folder}/{taken[-1]}")) if taken else (0, None)


def extract_new(df: DataFrame, state: str, source: str, *, keys: Sequence[str], modified_column: str,
                lookback_days: int = 3) -> Extract:
    """Versions (``keys``, ``modified_column``) of ``df`` that no committed extract of ``source`` has delivered.

    ``state``: a folder in shared storage for the marks of any number of
    sources.  The modified column is a date or a timestamp; a longer look-back
    than the last extract's finds no pairs for the days between, and so delivers
    their rows again.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[modified_column]
    if kind not in MARK_TIMES:
        raise TypeError(f"{modified_column} is {kind}, neither a date nor a timestamp")
    write_time, read_time, before = MARK_TIMES[kind]
    pair = [*keys, modified_column]
    home = f"{state.rstrip('/')}/{key_name(source)}"
    folder = f"{home}/marks"
    number, mark = last_mark(spark, folder)

    def since(high: object) -> Column:
        return F.col(modified_column) >= before(read_time(high), lookback_days)

    new, pairs, latest = df.filter(F.col(modified_column).isNotNull()), None, F.max(modified_column)
    if mark:
        pairs = spark.read.schema(df.select(*pair).schema).parquet(mark["pairs"]).filter(since(mark["high"]))
        known = pairs.select(*[F.col(c).alias(f"__known_{i}") for i, c in enumerate(pair)])
        same = [F.col(c).eqNullSafe(F.col(f"__known_{i}")) for i, c in enumerate(pair)]
        new = new.filter(since(mark["high"])).join(known, same, "left_anti")
        latest = F.greatest(latest, read_time(mark["high"]))
    rows, found = stage(new, "extract", metrics=[write_time(latest).alias("high")])
    out = Extract(rows, int(found["rows"]), found["path"], number, folder, None)
    if out.count:
        high = found["high"]
        kept = rows.select(*pair) if pairs is None else rows.select(*pair).unionByName(pairs)
        path = f"{home}/pairs/{uuid.uuid4().hex}"
        kept.filter(since(high)).distinct().write.parquet(path)
        out.mark = {"source": source, "high": high, "pairs": path, "rows": out.count}
    return out
