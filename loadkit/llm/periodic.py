"""Periodic runs of words, by difference-cover extensions on a harmonic grid (operator 12).

A run is a stretch of words that repeats with a smallest period q, is at
least ``max(LEAST, TIMES * q)`` words long and cannot be extended.

Words of a slice of documents become numbers, one sequence with a number of
its own before, between and after the documents, so nothing reaches across.

1. Harmonic grid.  In a run of period q at least ``max(LEAST, TIMES * q) - q``
   places in a row hold the word that comes q places later, so one of them
   lies on a grid that wide.  Over all periods that are n/3 + n/6 + n/9 ...
   places to look at.
2. Longest common extensions, to the right and (on the sequence reversed) to
   the left, of the grid places where the words q apart agree, give the whole
   run.  Only the suffixes that start in a difference cover modulo ``COVER``
   are sorted, by their first ``COVER`` words and then by doubling; the
   common prefixes of neighbours go into a sparse table.  Any two places
   reach sorted suffixes after the same few words, which are compared one by
   one; the rest is a minimum over a range of the table.
3. A stretch is also found under multiples of its period; the smallest counts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loadkit.llm import textbatch as tb
from loadkit.llm.lean import lean

LEAST, TIMES = 6, 4
COVER = 21
#: Differences of these residues give every residue modulo 21.
RESIDUES = (0, 1, 4, 14, 16)
ROWS = 1 << 16  # pairs compared word by word at a time
JOINED = 1 << 16  # words joined to bytes at a time
PLACES = 1 << 20  # grid places whose runs are looked for at a time


def synchronised() -> np.ndarray:
    """For residues (i, j): the fewest steps after which both places are in the cover."""
    inside = np.isin(np.arange(COVER), RESIDUES)
    steps = np.arange(COVER)
    at = (np.arange(COVER)[:, None] + steps) % COVER
    both = inside[at][:, None, :] & inside[at][None, :, :]
    if not both.any(axis=2).all():
        raise ValueError("the residues are no difference cover")
    return both.argmax(axis=2)


class Extensions:
    """How far two places of a sequence (numbers from 1) go on alike.

    The sequence must end with a number that occurs once, so no two suffixes are equal.
    """

    def __init__(self, seq: np.ndarray):
        self.seq, self.n = seq, len(seq)
        self.steps = synchronised()
        place = np.full(COVER, -1)
        place[list(RESIDUES)] = np.arange(len(RESIDUES))
        self.place = place
        grid = (np.arange(0, self.n, COVER)[:, None] + np.array(RESIDUES)).ravel()
        self.samples = grid[grid < self.n]
        self._sort()

    def _number(self, at: np.ndarray) -> np.ndarray:
        """Numbers of sampled places."""
        return at // COVER * len(RESIDUES) + self.place[at % COVER]

    def _sort(self) -> None:
        m = len(self.samples)
        bits = max(int(self.seq.max()).bit_length(), 1)
        per = 63 // bits
        padded = np.concatenate([self.seq, np.zeros(COVER, self.seq.dtype)])
        keys = []
        for a in range(0, COVER, per):
            key = np.zeros(m, np.int64)
            for b in range(a, min(a + per, COVER)):
                key <<= bits
                key |= padded[self.samples + b]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(m, bool)
        for key in keys:
            own = key[order]
            new[1:] |= own[1:] != own[:-1]
        del keys, padded
        rank = np.empty(m, np.int32)
        rank[order] = np.cumsum(new)
        levels, shift = [rank], len(RESIDUES)
        while int(rank.max()) + 1 < m:
            # Ranks by twice as many words: the rank here and the rank that many words on.
            key = rank.astype(np.int64) * (m + 1)
            key[:m - shift] += rank[shift:] + 1
            order = np.argsort(key, kind="stable")
            own = key[order]
            rank = np.empty(m, np.int32)
            rank[order] = np.concatenate(([0], np.cumsum(own[1:] != own[:-1])))
            levels.append(rank)
            shift *= 2
        self.rank = rank
        self.table = self._sparse(self._neighbours(order, levels))

    def _neighbours(self, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each two neighbours in the order: by ever shorter ranks, then word by word."""
        a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = np.flatnonzero(levels[k][a] == levels[k][b])
            common[same] += COVER << k
            a[same] += len(RESIDUES) << k
            b[same] += len(RESIDUES) << k
        x, y = self.samples[a], self.samples[b]
        return common + self._word_by_word(x, y, np.full(len(x), COVER))

    def _word_by_word(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words alike from (x, y) on, up to ``most``; the places left shrink with every word."""
        out = np.zeros(len(x), np.int64)
        left = np.flatnonzero(most > 0)
        step = 0
        while len(left):
            end = self.n - 1
            alike = self.seq[np.minimum(x[left] + step, end)] == self.seq[np.minimum(y[left] + step, end)]
            left = left[alike]
            step += 1
            out[left] = step
            left = left[most[left] > step]
        return out

    @staticmethod
    def _sparse(common: np.ndarray) -> list[np.ndarray]:
        """Minima of ranges of 1, 2, 4, ... values."""
        table = [common.astype(np.int32)]
        width = 1
        while 2 * width <= len(common):
            last = table[-1]
            table.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        return table

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Numbers of words alike from the places i and j (i < j) on."""
        out = np.empty(len(i), np.int64)
        for a in range(0, len(i), ROWS):
            x, y = i[a:a + ROWS], j[a:a + ROWS]
            steps = self.steps[x % COVER, y % COVER]
            own = self._word_by_word(x, y, steps)
            far = np.flatnonzero(own == steps)
            p, q = (self.rank[self._number(z[far] + steps[far])] for z in (x, y))
            low, high = np.minimum(p, q), np.maximum(p, q)
            level = np.frexp((high - low).astype(float))[1] - 1
            rest = np.empty(len(far), np.int64)
            for k in np.unique(level):
                at = level == k
                row = self.table[k]
                rest[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
            own[far] += rest
            out[a:a + ROWS] = own
        return out


@dataclass
class Runs:
    """Runs of a sequence by start, then period."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def grid_places(seq: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) on the harmonic grid where the words a period apart agree, as do their neighbours on a side.

    Documents come longest first: those that can hold a run of a period are the
    sequence's front, up to ``ends``.  About ``PLACES`` places come at a time.
    """
    places, periods, count = [], [], 0
    at_least = len(sizes)
    for q in range(1, int(sizes.max(initial=0)) // TIMES + 1):
        need = max(LEAST, TIMES * q)
        while at_least and sizes[at_least - 1] < need:
            at_least -= 1
        if not at_least:
            break
        front = seq[:ends[at_least - 1]]
        step = need - q
        hit = np.flatnonzero(front[:-q:step] == front[q::step]) * step
        if len(hit):
            # The first and last number of the sequence occur once, so both neighbours exist.
            hit = hit[(seq[hit + 1] == seq[hit + q + 1]) | (seq[hit - 1] == seq[hit + q - 1])]
        if len(hit):
            places.append(hit)
            periods.append(np.full(len(hit), q))
            count += len(hit)
            if count >= PLACES:
                yield np.concatenate(places), np.concatenate(periods)
                places, periods, count = [], [], 0
    if count:
        yield np.concatenate(places), np.concatenate(periods)


def runs_of(seq: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> Runs:
    """All runs of the documents in ``seq``; see ``sequence``."""
    none = np.zeros(0, np.int64)
    found, right, left, last = (none, none, none), None, None, len(seq) - 1
    for i, q in grid_places(seq, ends, sizes):
        if right is None:
            right, left = Extensions(seq), Extensions(np.ascontiguousarray(seq[::-1]))
        # To the left on the reversed sequence; both counts have the place itself.
        after, before = right.of(i, i + q), left.of(last - i - q, last - i)
        start, length = i - before + 1, after + before - 1 + q
        long = length >= np.maximum(LEAST, TIMES * q)
        start, length, q = (np.concatenate(x) for x in zip(found, (start[long], length[long], q[long]), strict=True))
        order = np.lexsort((q, length, start))
        start, length, q = start[order], length[order], q[order]
        first = np.ones(len(start), bool)
        first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
        found = start[first], length[first], q[first]
    start, length, q = found
    order = np.lexsort((q, start))
    return Runs(start[order], length[order], q[order])


def sequence(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, each document's first place, ends and sizes longest first) of documents as word numbers from 0."""
    sizes = np.array([len(w) for w in words])
    order = np.argsort(-sizes, kind="stable")
    ends = 1 + np.cumsum(sizes[order] + 1)
    most = 1 + max((int(w.max()) for w in words if len(w)), default=0)
    seq = np.empty(int(sizes.sum()) + len(words) + 1, np.int32)
    seq[0] = most + 1
    starts = np.empty(len(words), np.int64)
    for k, d in enumerate(order.tolist()):
        starts[d] = ends[k] - sizes[d] - 1
        seq[starts[d]:ends[k] - 1] = words[d] + 1
        seq[ends[k] - 1] = most + 2 + k
    return seq, starts, ends, sizes[order]


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
    """The words of the byte ranges joined by one space, in pieces."""
    for a in range(0, len(starts), JOINED):
        first, size = starts[a:a + JOINED], ends[a:a + JOINED] - starts[a:a + JOINED]
        to = np.cumsum(size + 1)
        out = np.full(int(to[-1]), 32, np.uint8)
        places = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[places + np.repeat(to - size - 1, size)] = data[places + np.repeat(first, size)]
        yield out[:-1].tobytes() if a + JOINED >= len(starts) else out.tobytes()


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """The planted repetition: for a tenth of the ids, the words from some place on repeat a stretch there.

    Returns which word each place takes, None where the text stays as it is.
    """
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>"
REPORT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def slice_runs(s: tb.TextSlice, ids: list, tail: bool):
    """(word ranges and, for each row, its place in them and its runs) of a slice."""
    w = tb.words(s)
    _, number = np.unique(w.hashes, return_inverse=True)
    bounds = w.bounds.tolist()
    places = []
    for d in range(s.n):
        own = repeated_tail(ids[d], bounds[d + 1] - bounds[d]) if tail else None
        places.append(np.arange(bounds[d], bounds[d + 1]) if own is None else bounds[d] + own)
    seq, starts, ends, sizes = sequence([number[p] for p in places])
    runs = runs_of(seq, ends, sizes)
    order = np.argsort(starts, kind="stable")
    owner = order[np.searchsorted(starts[order], runs.start, side="right") - 1]
    by_doc = np.argsort(owner, kind="stable")
    cut = np.searchsorted(owner[by_doc], np.arange(s.n + 1))
    return w, places, [(runs.start[k] - starts[d], runs.length[k], runs.period[k])
                       for d in range(s.n) for k in (by_doc[cut[d]:cut[d + 1]],)]


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay when each run keeps its first period."""
    if not len(start):
        return np.ones(n, bool)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:n]) == 0


def strongest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    """The run of greatest length over period; among equal ones the first by start, then period."""
    best = 0
    for k in range(1, len(start)):
        if int(length[k]) * int(period[best]) > int(length[best]) * int(period[k]):
            best = k
    return best


def _rows(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].alias("text"))


def periodic_runs(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) of every row of ``documents``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0, and are alike if their 64-bit hashes are.  Null, empty and blank
    texts have no words and no runs.  Rows with a null or repeated id are rows
    like others.  An empty table gives no rows; other columns are ignored.
    """
    @lean
    def run(batches):
        for batch in batches:
            for s in tb.slices(batch.column(1)):
                w, _, found = slice_runs(s, [None] * s.n, False)
                flat = [np.concatenate([r[k] for r in found]) for k in range(3)]
                cut = np.concatenate(([0], np.cumsum([len(r[0]) for r in found])))
                runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in flat], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.first, s.n), pa.array(np.diff(w.bounds), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(cut, pa.int32()), runs)], names=["doc_id", "n_words", "runs"])

    return _rows(documents, id_column, text_column).mapInArrow(run, SCHEMA)


def collapse_runs(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text of every row of ``documents``: its words joined by one space, of each run only the first period.

    A null text stays null; other cases as in ``periodic_runs``.
    """
    @lean
    def run(batches):
        for batch in batches:
            for s in tb.slices(batch.column(1)):
                w, places, found = slice_runs(s, [None] * s.n, False)
                texts = []
                for d, place in enumerate(places):
                    left = place[kept_words(len(place), *found[d])]
                    null = not batch.column(1)[s.first + d].is_valid
                    texts.append(None if null else b"".join(joined(s.data, w.starts[left], w.ends[left])).decode())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n), pa.array(texts, pa.string())],
                                                 names=["doc_id", "text"])

    return _rows(documents, id_column, text_column).mapInArrow(run, "doc_id long, text string")


def run_report(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
               tail: bool = True) -> DataFrame:
    """See REPORT; with ``tail`` the texts first take the planted repetition (``repeated_tail``).

    n_runs; of the run with the greatest length over period its start,
    length, period and exponent in thousandths (nulls without a run); a
    digest of all runs (``start,length,period`` and a line feed each) and of
    the collapsed words.  Cases as in ``periodic_runs``; a row without an id takes no repetition.
    """
    @lean
    def run(batches):
        for batch in batches:
            for s in tb.slices(batch.column(1)):
                ids = batch.column(0).slice(s.first, s.n)
                w, places, found = slice_runs(s, ids.to_pylist(), tail)
                rows = []
                for place, own in zip(places, found, strict=True):
                    lines = "".join(f"{a},{b},{c}\n" for a, b, c in zip(*(x.tolist() for x in own), strict=True))
                    top = (None,) * 4
                    if lines:
                        k = strongest(*own)
                        a, b, c = (int(x[k]) for x in own)
                        top = (a, b, c, 1000 * b // c)
                    left = place[kept_words(len(place), *own)]
                    text = hashlib.sha256()
                    for piece in joined(s.data, w.starts[left], w.ends[left]):
                        text.update(piece)
                    rows.append((len(own[0]), *top, hashlib.sha256(lines.encode()).hexdigest(), text.hexdigest()))
                types = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True))],
                    names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                           "collapsed_sha256"])

    return _rows(documents, id_column, text_column).mapInArrow(run, REPORT)
