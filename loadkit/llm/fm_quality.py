"""Quality classifier: a factorisation machine (operator 1).

Features of a document: its words, hashed into ``BUCKETS`` (square root of
the count, unit length); structure statistics (shares of letters, digits,
symbols, repeated words, line and word lengths, ...) and metadata (``n_chars``)
as standardised values and as quantile bins.  Every feature has a weight and
a vector of ``RANK`` numbers; the score is

    w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2)

so all pairwise interactions cost time linear in the features.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadkit.llm import textbatch as tb
from loadkit.llm.lean import lean
from loadkit.llm.learning import PER_CLASS, fit_in_one_task, held_out, labelled_sample

BUCKETS = 1 << 14
RANK = 8
BINS = 8
EPOCHS = 12
RATE = 0.05
DECAY = 1e-4
THRESHOLD = 0.7
STATS = ("log_words", "word_length", "upper", "digits", "symbols", "stops", "other_bytes", "blank_lines",
         "words_a_line", "distinct_words", "doubled_words", "long_words", "wordless", "lines")


def word_features(s: tb.TextSlice, w: tb.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value), rows ascending."""
    row = np.repeat(np.arange(s.n), np.diff(w.bounds))
    bucket = (w.hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    place, count = np.unique(row * BUCKETS + bucket, return_counts=True)
    row = place // BUCKETS
    return row, place % BUCKETS, np.sqrt(count / np.diff(w.bounds)[row])


def statistics(s: tb.TextSlice, w: tb.Words) -> np.ndarray:
    """(rows, len(STATS)) of a slice; rows without words have zeros but for sizes."""
    data, bounds = s.data, w.bounds

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return (total[s.offsets[1:]] - total[s.offsets[:-1]]) / np.maximum(np.diff(s.offsets), 1)

    def mean(values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(values, dtype=float)))
        return (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(n, 1)

    n = np.diff(bounds)
    length = w.ends - w.starts
    row = np.repeat(np.arange(s.n), n)
    lower = (data >= 97) & (data <= 122)
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    high = data >= 128
    space = tb.is_space(data)
    stop = (data == 46) | (data == 44) | (data == 33) | (data == 63)
    symbol = ~(lower | upper | digit | high | space | stop)
    letters = np.concatenate(([0], np.cumsum(lower | upper | high)))
    breaks = share(data == 10) * np.diff(s.offsets)
    empty = np.concatenate(([False], (data[1:] == 10) & (data[:-1] == 10))) if len(data) else data == 10
    keys = np.unique(tb.mix(w.hashes + row.astype(np.uint64)))
    doubled = np.concatenate(([False], (w.hashes[1:] == w.hashes[:-1]) & (row[1:] == row[:-1]))) if len(row) else row
    _, first = np.unique(tb.mix(w.hashes + row.astype(np.uint64)), return_index=True)
    new = np.bincount(row[first], minlength=s.n) if len(keys) else np.zeros(s.n)
    columns = [np.log1p(n), mean(length), share(upper), share(digit), share(symbol), share(stop), share(high),
               share(empty), np.log1p(n / (breaks + 1)), new / np.maximum(n, 1), mean(doubled), mean(length > 12),
               mean(letters[w.ends] == letters[w.starts]), np.log1p(breaks)]
    return np.stack(columns, axis=1)


class Machine:
    """A fitted factorisation machine and the scales of its statistics."""

    FIELDS = ("bias", "weights", "vectors", "mean", "spread", "edges")

    def __init__(self, **arrays):
        for k in self.FIELDS:
            setattr(self, k, arrays[k])

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: getattr(self, k) for k in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Machine:
        with np.load(io.BytesIO(data)) as f:
            return cls(**{k: f[k] for k in cls.FIELDS})

    def dense(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature, value) matrices of statistics: their scaled values and their bins."""
        n, m = stats.shape
        scaled = np.clip((stats - self.mean) / self.spread, -4, 4) / 4
        bins = np.stack([np.searchsorted(self.edges[j], stats[:, j]) for j in range(m)], axis=1)
        feature = np.concatenate([np.broadcast_to(BUCKETS + np.arange(m), (n, m)),
                                  BUCKETS + m + np.arange(m) * BINS + bins], axis=1)
        return feature, np.concatenate([scaled, np.full((n, m), 0.5)], axis=1)


def _joined(row, bucket, value, feature, dense, n):
    """One sparse matrix (starts, feature, value) by rows, of words and dense features."""
    m = feature.shape[1]
    rows = np.concatenate([row, np.repeat(np.arange(n), m)])
    order = np.argsort(rows, kind="stable")
    starts = np.searchsorted(rows[order], np.arange(n))
    return (starts, np.concatenate([bucket, feature.ravel()])[order],
            np.concatenate([value, dense.ravel()])[order].astype(np.float32))


def raw_scores(m: Machine, starts, feature, value) -> tuple[np.ndarray, np.ndarray]:
    """(scores, sums of v x by row): the sum-of-squares identity.  Every row has features."""
    vx = m.vectors[feature] * value[:, None]
    sums = np.add.reduceat(vx, starts, axis=0)
    squares = np.add.reduceat(vx * vx, starts, axis=0)
    linear = np.add.reduceat(m.weights[feature] * value, starts)
    return m.bias[0] + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums


def chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_machine(y, weight, words: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray) -> Machine:
    """AdaGrad on the weighted logistic loss; the same on every run."""
    rng = np.random.default_rng(17)
    size = BUCKETS + stats.shape[1] * (BINS + 1)
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    m = Machine(bias=np.zeros(1, np.float32), weights=np.zeros(size, np.float32),
                vectors=rng.normal(0, 0.05, (size, RANK)).astype(np.float32),
                mean=stats.mean(axis=0), spread=np.maximum(stats.std(axis=0), 1e-6), edges=edges)
    feature, dense = m.dense(stats)
    grown = {"bias": 1e-8, "weights": np.full(size, 1e-8, np.float32), "vectors": np.full((size, RANK), 1e-8, np.float32)}
    weight = weight / weight.mean()
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 64):
            rows = order[at:at + 64]
            row = np.repeat(np.arange(len(rows)), [len(words[r][0]) for r in rows])
            bucket = np.concatenate([words[r][0] for r in rows])
            value = np.concatenate([words[r][1] for r in rows])
            starts, f, x = _joined(row, bucket, value, feature[rows], dense[rows], len(rows))
            score, sums = raw_scores(m, starts, f, x)
            slope = ((chance(score) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            each = np.repeat(slope, np.diff(np.append(starts, len(f))))
            owner = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(f))))
            used, place = np.unique(f, return_inverse=True)
            by_weight = np.bincount(place, weights=each * x, minlength=len(used)) + DECAY * m.weights[used]
            pull = (each * x)[:, None] * (sums[owner] - m.vectors[f] * x[:, None])
            by_vector = np.stack([np.bincount(place, weights=pull[:, k], minlength=len(used))
                                  for k in range(RANK)], axis=1) + DECAY * m.vectors[used]
            grown["bias"] += slope.sum() ** 2
            m.bias -= RATE * slope.sum() / np.sqrt(grown["bias"])
            grown["weights"][used] += by_weight ** 2
            m.weights[used] -= (RATE * by_weight / np.sqrt(grown["weights"][used])).astype(np.float32)
            grown["vectors"][used] += by_vector ** 2
            m.vectors[used] -= (RATE * by_vector / np.sqrt(grown["vectors"][used])).astype(np.float32)
    return m


def _with_meta(stats: np.ndarray, batch: pa.RecordBatch, columns: range, s: tb.TextSlice) -> np.ndarray:
    """Statistics and log-scaled metadata; a null is 0."""
    meta = [np.log1p(np.maximum(np.nan_to_num(batch.column(c).slice(s.first, s.n).cast(pa.float64())
                                              .to_numpy(zero_copy_only=False)), 0)) for c in columns]
    return np.column_stack([stats, *meta])


def train(documents: DataFrame, labels: DataFrame, *, label: str, id_column: str, text_column: str,
          metadata: tuple[str, ...], per_class: int) -> Machine | None:
    """None without labelled documents of both classes."""
    columns = [documents[text_column].alias("text"),
               *[documents[c].cast("double").alias(f"meta_{k}") for k, c in enumerate(metadata)]]
    rows = labelled_sample(documents, labels, label, columns, id_column=id_column, per_class=per_class)

    @lean
    def features(batches):
        for batch in batches:
            for s in tb.slices(batch.column(3)):
                w = tb.words(s, lower=True)
                row, bucket, value = word_features(s, w)
                bounds = np.searchsorted(row, np.arange(s.n + 1)).astype(np.int32)
                stats = _with_meta(statistics(s, w), batch, range(4, batch.num_columns), s)
                own = [batch.column(k).slice(s.first, s.n) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.ListArray.from_arrays(pa.array(bounds), pa.array(bucket.astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(bounds), pa.array(value.astype(np.float32))),
                     pa.array(list(stats), pa.list_(pa.float64()))],
                    names=["order", "label", "weight", "buckets", "counts", "stats"])

    def fit(t: pa.Table) -> bytes | None:
        y = t["label"].to_numpy().astype(float)
        if y.min() == y.max():
            return None
        words = [(np.asarray(b.values), np.asarray(v.values))
                 for b, v in zip(t["buckets"], t["counts"], strict=True)]
        stats = np.array(t["stats"].to_pylist())
        return fit_machine(y, t["weight"].to_numpy(), words, stats).dump()

    made = fit_in_one_task(rows.mapInArrow(features, "order long, label int, weight double, buckets array<int>, "
                                           "counts array<float>, stats array<double>"), fit)
    return Machine.load(made) if made else None


def quality_scores(documents: DataFrame, labels: DataFrame, *, label: str = "quality", id_column: str = "doc_id",
                   text_column: str = "text", metadata: tuple[str, ...] = ("n_chars",),
                   per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted of every row of ``documents``.

    The machine learns from at most ``per_class`` labelled rows of each class.
    Null and empty texts are scored by their statistics alone; null metadata
    counts as 0; repeated rows score alike; without labels of both classes
    every score is 0.5.  An empty table gives no rows; other columns are
    ignored.
    """
    m = train(documents, labels, label=label, id_column=id_column, text_column=text_column, metadata=metadata,
              per_class=per_class)
    rows = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].alias("text"),
                            *[documents[c].cast("double").alias(f"meta_{k}") for k, c in enumerate(metadata)])
    packed = m.dump() if m else None

    @lean
    def run(batches):
        machine = Machine.load(packed) if packed else None
        for batch in batches:
            for s in tb.slices(batch.column(1)):
                if machine is None:
                    p = np.full(s.n, 0.5)
                else:
                    w = tb.words(s, lower=True)
                    stats = _with_meta(statistics(s, w), batch, range(2, batch.num_columns), s)
                    p = chance(raw_scores(machine, *_joined(*word_features(s, w), *machine.dense(stats), s.n))[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n), pa.array(p.astype(float))],
                                                 names=["doc_id", "score"])

    return (rows.mapInArrow(run, "doc_id long, score double")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
