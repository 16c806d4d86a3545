"""Finished steps of a load, so that a re-run goes on behind the last one.

A step (rows read, routed rows staged, error rows written, rows appended or
published) leaves one create-if-absent entry ``<path>/<batch>/<step>`` when it
is done, with its counts and the folder it wrote.  A load that runs again
under its batch id takes those over: a staged table is read back in place of
the source, a finished write is not repeated.  A step that died before its
entry runs again, in a new folder.

The batch id names the input.  A re-run whose staged columns differ is
refused, and so is one whose staged table is gone; both want a new batch id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from loadkit.session import path_exists
from loadkit.sinks.ledger import create_entry, key_name, read_entry


class StepMismatch(ValueError):
    """A batch id was used before for other columns, or its staged rows are gone."""


class Steps:
    """The steps of one batch; without a ``path`` nothing is kept and every step runs."""

    def __init__(self, spark: SparkSession, path: str | None, batch_id: str,
                 on_reuse: Callable[[str], None] = lambda step: None):
        self.spark, self.batch_id, self.on_reuse = spark, batch_id, on_reuse
        self.folder = f"{path.rstrip('/')}/{key_name(batch_id)}" if path else None

    def done(self, name: str) -> dict | None:
        """What the step left; None if it has not finished."""
        return read_entry(self.spark, f"{self.folder}/{name}") if self.folder else None

    def once(self, name: str, run: Callable[[], dict]) -> dict:
        """What the step left, from an earlier run or from ``run`` now.

        Of two runs of one batch at once, the first to finish decides.
        """
        known = self.done(name)
        if known is not None:
            self.on_reuse(name)
            return known
        left = run()
        if self.folder and not create_entry(self.spark, f"{self.folder}/{name}", left):
            return self.done(name)
        return left

    def staged(self, name: str, columns: str, run: Callable[[], dict]) -> dict:
        """As ``once``, for a step that leaves a table at ``path`` with these ``columns``."""
        left = self.once(name, lambda: {**run(), "columns": columns})
        if left["columns"] != columns:
            raise StepMismatch(f"batch {self.batch_id} was staged with other columns: {left['columns']}")
        if not path_exists(self.spark, left["path"]):
            raise StepMismatch(f"the staged rows of batch {self.batch_id} are gone: {left['path']}")
        return left
