"""Quality rules with an n-gram log-likelihood ratio (operator 7).

Word n-grams are hashed into ``BUCKETS`` counters.  One pass counts them in
all documents (the raw corpus) and in the trusted documents.  A bucket's log
ratio is ``log((trusted + PRIOR) / (expected + PRIOR))``, where ``expected``
is what the trusted documents would hold if they were like the raw corpus;
the prior keeps rare n-grams near 0.  A document's score is the mean over its
n-grams, so length does not matter, and it is kept from ``threshold`` on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadkit.llm import textbatch as tb
from loadkit.llm.graph import some_ids
from loadkit.llm.lean import lean

BUCKETS = 1 << 16
ORDERS = (1, 2)
PRIOR = 5.0
THRESHOLD = -0.25
FEW_WORDS, REPEATED_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"


def grams(w: tb.Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every n-gram of a slice."""
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    row = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
    buckets, rows = [], []
    for k in ORDERS:
        h = tb.windows(w.hashes, k, 20 + k)
        whole = row[:len(h)] == row[k - 1:k - 1 + len(h)]
        buckets.append((h[whole] >> shift).astype(np.int64))
        rows.append(row[:len(h)][whole])
    return np.concatenate(buckets), np.concatenate(rows)


def bucket_counts(documents: DataFrame, trusted: DataFrame, id_column: str, text_column: str) -> np.ndarray:
    """(2, BUCKETS): n-grams of all documents and of the trusted ones (ids in ``trusted``, one column).

    Each task adds up its own rows; Spark adds the tasks' counters.  Only the
    fixed number of totals comes to the driver.
    """
    ids = some_ids(trusted.select(F.col(trusted.columns[0]).alias("__id")).filter("__id is not null").distinct())
    rows = documents.select(documents[id_column].alias("__of"), documents[text_column].alias("text"))
    marked = rows.join(ids, F.col("__of") == F.col("__id"), "left").select("text", F.col("__id").isNotNull())

    @lean
    def count(batches):
        totals = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for s in tb.slices(batch.column(0)):
                bucket, row = grams(tb.words(s))
                totals[0] += np.bincount(bucket, minlength=BUCKETS)
                totals[1] += np.bincount(bucket[good[s.first + row]], minlength=BUCKETS)
        some = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[0][some]), pa.array(totals[1][some])],
                                         names=["bucket", "raw", "trusted"])

    counted = (marked.mapInArrow(count, "bucket long, raw long, trusted long").groupBy("bucket")
               .agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))).toPandas()
    totals = np.zeros((2, BUCKETS), np.int64)
    totals[0, counted["bucket"]], totals[1, counted["bucket"]] = counted["raw"], counted["trusted"]
    return totals


def log_ratios(totals: np.ndarray) -> np.ndarray:
    """0 throughout if nothing is trusted."""
    raw, trusted = totals.astype(float)
    if not trusted.sum():
        return np.zeros(BUCKETS)
    expected = raw * (trusted.sum() / raw.sum())
    return np.log((trusted + PRIOR) / (expected + PRIOR))


def _per_row(where: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of ``where`` are set between each row's bounds."""
    total = np.concatenate(([0], np.cumsum(where)))
    return total[bounds[1:]] - total[bounds[:-1]]


def base_counts(s: tb.TextSlice, w: tb.Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a slice's rows."""
    n = len(s.offsets) - 1
    data = s.data
    letters = ~tb.is_space(data) & ((data & 0xC0) != 0x80)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    solid = np.concatenate(([0], np.cumsum(~tb.is_space(data))))
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate((s.offsets[:-1], breaks + 1)))
    starts = starts[starts < len(data)]
    line_row = np.searchsorted(s.offsets, starts, side="right") - 1
    ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, starts)], s.offsets[line_row + 1])
    worded = solid[ends] > solid[starts]
    starts, ends, line_row = starts[worded], ends[worded], line_row[worded]
    lines = tb.mix(tb.run_hashes(data, starts, ends, seed=3) + line_row.astype(np.uint64))
    _, first = np.unique(lines, return_index=True)
    again = np.ones(len(lines), bool)
    again[first] = False

    row = np.repeat(np.arange(n), np.diff(w.bounds))
    runs = tb.windows(w.hashes, WINDOW, 5)
    whole = row[:len(runs)] == row[WINDOW - 1:WINDOW - 1 + len(runs)]
    at = np.flatnonzero(whole)
    _, kind, count = np.unique(tb.mix(runs[at] + row[at].astype(np.uint64)), return_inverse=True, return_counts=True)
    at = at[count[kind] > 1]
    change = np.zeros(len(w.hashes) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    covered = np.cumsum(change[:-1]) > 0
    return {"n_words": np.diff(w.bounds), "word_chars": _per_row(letters, s.offsets),
            "n_symbols": _per_row(symbol[data], s.offsets),
            "n_dup_lines": np.bincount(line_row[again], minlength=n),
            "n_repeat_words": _per_row(covered, w.bounds)}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_rules(documents: DataFrame, trusted: DataFrame, *, id_column: str = "doc_id",
                  text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rules and score of every row of ``documents``; ``trusted`` has the trusted ids in its first column.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, llr, base_failed, kept.  A document fails the base rules
    with fewer than 20 words, or if more than 30 % of its words lie in 8-word
    windows that occur twice in it.  Otherwise the log-likelihood ratio
    decides.  Null and empty texts have no words (llr 0) and fail.  Rows are
    judged one by one, repeated ones alike; rows without an id are never
    trusted; an empty table gives no rows; other columns are ignored.
    """
    ratios = log_ratios(bucket_counts(documents, trusted, id_column, text_column))

    @lean
    def score(batches):
        for batch in batches:
            for s in tb.slices(batch.column(1)):
                w = tb.words(s)
                counts = base_counts(s, w)
                bucket, row = grams(w)
                total = np.bincount(row, weights=ratios[bucket], minlength=s.n)
                llr = total / np.maximum(np.bincount(row, minlength=s.n), 1)
                failed = ((counts["n_words"] < FEW_WORDS)
                          | (100 * counts["n_repeat_words"] > REPEATED_PERCENT * counts["n_words"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.first, s.n), *[pa.array(counts[c].astype(np.int64)) for c in COUNTS],
                     pa.array(llr), pa.array(failed), pa.array(~failed & (llr >= threshold))],
                    names=["doc_id", *COUNTS, "llr", "base_failed", "kept"])

    schema = f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, llr double, base_failed boolean, kept boolean"
    return documents.select(documents[id_column].cast("long"), documents[text_column]).mapInArrow(score, schema)
