"""Stop a staging write as soon as its error rows pass the limit (RTE3, the file job's skip limit).

Without it a load stages its whole input and is refused afterwards.  Here each
task reports, when it ends, how many error rows its partition had, and the
driver cancels the write when the sum passes the limit: input that is bad from
its first files on costs the tasks that ran so far.

The count needs one boolean column to pass through Python (an Arrow UDF; the
other columns stay in the JVM), so it is for loads that ask for it.  Counts are
kept by partition and the larger one holds, so a task that runs again, or
twice at once, is not counted twice.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from loadkit.operators.routing import ErrorLimitExceeded

POLL_SECONDS = 0.1


def rows_by_partition(spark: SparkSession) -> Accumulator:
    from pyspark.accumulators import AccumulatorParam

    class Largest(AccumulatorParam):  # defined here so that it travels by value to the workers
        def zero(self, value):
            return {}

        def addInPlace(self, a, b):
            for part, n in b.items():
                a[part] = max(a.get(part, 0), n)
            return a

    return spark.sparkContext.accumulator({}, Largest())


class EarlyStop:
    """The limit of one write: ``counted`` goes into its plan, ``watching`` around its action."""

    def __init__(self, spark: SparkSession, limit: int):
        self.spark, self.limit = spark, limit
        self._found = rows_by_partition(spark)

    def counted(self, flag: Column) -> Column:
        """``flag`` (a boolean that is never null) itself; its true rows are counted as a task goes over them."""
        found = self._found

        @F.arrow_udf("boolean")
        def seen(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            n = 0
            for flags in batches:
                n += pc.sum(flags).as_py() or 0
                yield flags
            if n:
                found.add({TaskContext.get().partitionId(): n})

        return seen.asNondeterministic()(flag)

    @property
    def errors(self) -> int:
        """Error rows of the tasks that have ended."""
        return sum(self._found.value.copy().values())

    @contextmanager
    def watching(self):
        """Cancel the jobs started inside by this thread once the limit is passed; then it is ``ErrorLimitExceeded``."""
        sc, tag = self.spark.sparkContext, f"early-stop-{uuid.uuid4().hex}"
        over, stopped = threading.Event(), False

        def watch():
            nonlocal stopped
            while not over.wait(POLL_SECONDS):
                if self.errors > self.limit:
                    stopped = True
                    sc.cancelJobsWithTag(tag)
                    return

        watcher = threading.Thread(target=watch, name=tag, daemon=True)
        sc.addJobTag(tag)
        watcher.start()
        try:
            yield
        except Exception as e:
            if not stopped:
                raise
            raise ErrorLimitExceeded(f"stopped early: at least {self.errors} error rows exceed the limit of "
                                     f"{self.limit}") from e
        finally:
            over.set()
            watcher.join()
            sc.removeJobTag(tag)
