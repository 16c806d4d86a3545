"""Toxicity by a subsequence string-kernel machine with Nyström landmarks (operator 4).

Strings are units of a sentence: words, with runs of single letters
("m o r o n") joined to one.  Letters are symbols: a-z, three classes of
bytes beyond ASCII, the unit's start and end; any other character inside a
unit is skipped, so marks put into an insult change nothing, and letters put
in or left out leave most of its subsequences.  The kernel counts common subsequences of four to eight
symbols within a few places, each gap costing a factor ``GAP``, normalised by
the unit's own weight.

Training, on labelled documents: landmarks are picked by pivoted Cholesky
among units that speak for toxic documents and ordinary ones; units are
mapped to the Nyström space of the landmarks and a linear machine with
squared hinge loss is fitted there.  A label says that some sentence is
toxic, not which: every round, each toxic document is represented by its
highest-scoring sentence unit, all units of clean documents are negative,
and the machine is fitted again.

The decision function is linear in the subsequence counts, so landmarks and
weights fold into one table of a weight per subsequence.  A long unit, in
which an insult would be lost, is learned from and scored as overlapping
windows, and a unit with marks inside also as the parts between them; the best
one counts.  A sentence scores
as its strongest unit, a document as its strongest sentence; a logistic
curve fitted on labelled documents kept aside turns that into 0 to 1.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from itertools import combinations, islice, tee

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadkit.llm import textbatch as tb
from loadkit.llm.lean import give_back, lean
from loadkit.llm.learning import PER_CLASS, fit_in_one_task, held_out, labelled_sample

GAP = 0.7
LANDMARKS = 384
CLEAN_UNITS = 8_000  # distinct units of clean sample documents the machine is fitted on
RUN = 1 << 17  # symbols scored together
BUILT = 1 << 14  # symbols whose subsequences are listed together; each is in some thirty
ROWS = 1 << 11  # rows of the fit that are added up together
FEW = 0.005  # share of the toxic documents a run of symbols must be in to tell
ROUNDS = 3
RIDGE = 1e-5
THRESHOLD = 0.3
NORM = 1.0  # power of a unit's own weight its counts are divided by: 1 would let long words hide a part
START_SYMBOL, END_SYMBOL = 30, 31
TABLE = 1 << 20  # numbers of subsequences
LONG = 24  # symbols; a longer unit is scored by its best window
WINDOW, STRIDE = 8, 2  # in a window of 24 symbols an insult of 5 to 10 is still lost
PART = 3  # letters a part of a unit between other characters must have to be scored by itself
#: Places of the symbols counted: four within six places, six within eight, and runs of eight.
PATTERNS = [*((0, *p) for p in combinations(range(1, 6), 3)), *((0, *p) for p in combinations(range(1, 8), 5)),
            tuple(range(8))]
RUNS = [tuple(range(n)) for n in (4, 6, 8)]


def symbols() -> np.ndarray:
    """Symbol of each byte: a-z 1 to 26, bytes beyond ASCII 27 to 29, else 0."""
    table = np.zeros(256, np.int64)
    table[97:123] = np.arange(1, 27)
    table[65:91] = np.arange(1, 27)
    table[128:] = 27 + np.arange(128) % 3
    return table


def units(s: tb.TextSlice, w: tb.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of a slice: (hash, first word, end word, row); runs of single letters are one unit."""
    n = len(w.starts)
    row = np.repeat(np.arange(s.n), np.diff(w.bounds))
    letter = (w.ends - w.starts == 1) & (symbols()[s.data[w.starts]] > 0)
    joins = np.zeros(n, bool)
    joins[1:] = letter[1:] & letter[:-1] & (row[1:] == row[:-1])
    first = np.flatnonzero(~joins)
    end = np.append(first[1:], n) if n else first
    several = end - first > 1
    # A joined run's hash is that of its words in order, told from single words by the salt.
    place = np.arange(n) - np.repeat(first, end - first)
    salted = tb.mix(w.hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(3))
    run = np.add.reduceat(salted, first) if n else salted
    return np.where(several, run, w.hashes[first]), first, end, row[first]


def marked_symbols(s: tb.TextSlice, w: tb.Words, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols with start and end marks, bounds) of the units from word ``first`` to before ``end``; 0: no symbol."""
    lens = w.ends - w.starts
    total = np.concatenate(([0], np.cumsum(lens)))
    size = total[end] - total[first] + 2
    bounds = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(bounds[-1], np.int64)
    out[bounds[:-1]] = START_SYMBOL
    out[bounds[1:] - 1] = END_SYMBOL
    counts = end - first
    words = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
    own = lens[words]
    at = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own) + np.repeat(w.starts[words], own)
    inside = np.ones(len(out), bool)
    inside[bounds[:-1]] = inside[bounds[1:] - 1] = False
    out[inside] = symbols()[s.data[at]]
    return out, bounds


def unit_symbols(s: tb.TextSlice, w: tb.Words, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols with start and end marks, bounds) of the units from word ``first`` to before ``end``."""
    out, bounds = marked_symbols(s, w, first, end)
    known = out > 0
    return out[known], np.concatenate(([0], np.cumsum(known)))[bounds]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of the ranges, one range after the other."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def pieces(s: tb.TextSlice, w: tb.Words, first: np.ndarray,
           end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the units from word ``first`` to before ``end`` are scored by: (symbols, starts in them, sizes, units).

    A unit itself; where other characters part its letters, also the parts of
    ``PART`` letters or more, with start and end marks.  Of these, those of
    more than ``LONG`` symbols are told by their windows of ``WINDOW`` symbols.
    """
    out, bounds = marked_symbols(s, w, first, end)
    n = len(first)
    inside = out > 0
    letter = inside.copy()
    letter[bounds[:-1]] = letter[bounds[1:] - 1] = False
    edge = np.diff(letter.astype(np.int8), prepend=0)
    at, to = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    unit = np.searchsorted(bounds, at, side="right") - 1
    some = (np.bincount(unit, minlength=n)[unit] > 1) & (to - at >= PART)
    at, size, unit = at[some], (to - at)[some], unit[some]
    parts = np.empty(int((size + 2).sum()), np.uint8)
    ends = np.cumsum(size + 2)
    mine = np.ones(len(parts), bool)
    mine[ends - size - 2] = mine[ends - 1] = False
    parts[ends - size - 2], parts[ends - 1] = START_SYMBOL, END_SYMBOL
    parts[mine] = out[ranges(at, size)]
    code = np.concatenate([out[inside].astype(np.uint8), parts])
    own = np.concatenate(([0], np.cumsum(inside)))[bounds]
    starts = np.concatenate([own[:-1], own[-1] + ends - size - 2])
    sizes = np.concatenate([np.diff(own), size + 2])
    owner = np.concatenate([np.arange(n), unit])
    count = np.where(sizes > LONG, -(-(sizes - WINDOW) // STRIDE) + 1, 1)
    item = np.repeat(np.arange(len(sizes)), count)
    length = np.where(sizes > LONG, WINDOW, sizes)[item]
    # The last window ends where its piece ends.
    begin = starts[item] + np.minimum(ranges(np.zeros(len(count), np.int64), count) * STRIDE, sizes[item] - length)
    order = np.argsort(owner[item], kind="stable")
    return code, begin[order], length[order], owner[item][order]


def subsequences(code: np.ndarray, bounds: np.ndarray, patterns=PATTERNS):
    """For each pattern of places: (subsequence number, whether it is in one unit, weight), by first place.

    A subsequence is numbered by a hash of its symbols into ``TABLE``.  The
    patterns have even lengths; symbols are packed in pairs first.
    """
    wide = code.astype(np.uint64)
    owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    steps = {b - a for p in patterns for a, b in zip(p[::2], p[1::2], strict=True)}
    pairs = {d: (wide[:-d] << np.uint64(5)) | wide[d:] for d in steps if len(wide) > d}
    alone = {last: owner[:-last] == owner[last:] for last in {p[-1] for p in patterns} if len(owner) > last}
    for p in patterns:
        n = len(code) - p[-1]
        if n <= 0:
            continue
        number = np.full(n, len(p), np.uint64)
        for a, b in zip(p[::2], p[1::2], strict=True):
            number <<= np.uint64(10)
            number |= pairs[b - a][a:a + n]
        number *= np.uint64(0x9E3779B97F4A7C15)
        number >>= np.uint64(64 - TABLE.bit_length() + 1)
        yield number.view(np.int64), alone[p[-1]], GAP ** (p[-1] + 1 - len(p))


def unit_blocks(bounds: np.ndarray, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of units of about ``size`` symbols (``BUILT`` by default)."""
    starts = np.arange(0, bounds[-1], size or BUILT)
    cuts = np.unique(np.append(np.searchsorted(bounds[:-1], starts), len(bounds) - 1)).tolist()
    return zip(cuts[:-1], cuts[1:], strict=True)


def table_scores(code: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Each unit's subsequence weights in ``table``, over the unit's norm; 0 without subsequences.

    Done in runs of units of about ``RUN`` symbols, whose arrays stay in the processor's cache.
    """
    out = [np.zeros(0)]
    for a, b in unit_blocks(bounds, RUN):
        own = bounds[a:b + 1] - bounds[a]
        some = code[bounds[a]:bounds[b]]
        total, energy = np.zeros(len(some), np.float32), np.zeros(len(some), np.float32)
        for number, ok, weight in subsequences(some, own):
            found = table[number]
            found *= ok
            found *= np.float32(weight)
            total[:len(number)] += found
            energy[:len(number)] += ok * np.float32(weight * weight)
        # Units have at least their start and end, so no range is empty.
        norm = np.maximum(np.add.reduceat(energy, own[:-1]), 1e-12) ** (NORM / 2)
        out.append(np.add.reduceat(total, own[:-1]) / norm)
    return np.concatenate(out)


def piece_scores(code: np.ndarray, starts: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``table_scores`` of pieces; their symbols are copied for about ``RUN`` symbols at a time."""
    ends = np.cumsum(sizes)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], RUN)), len(ends)))
    out = [np.zeros(0)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = sizes[a:b]
        out.append(table_scores(code[ranges(starts[a:b], own)], np.concatenate(([0], np.cumsum(own))), table))
    return np.concatenate(out)


class Margins:
    """Margins of units under a model; units already seen by this task are looked up by their hash."""

    def __init__(self, model, most: int = 1 << 20):
        self.table, self.bias, self.most = model[0], model[1], most
        self.hashes, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def of(self, s: tb.TextSlice, w: tb.Words, hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        names, one, place = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, names)
        at[at == len(self.hashes)] = 0
        known = self.hashes[at] == names if len(self.hashes) else np.zeros(len(names), bool)
        margins = np.empty(len(names))
        margins[known] = self.values[at[known]]
        new = ~known
        if new.any():
            *own, unit = pieces(s, w, first[one[new]], end[one[new]])
            best = np.maximum.reduceat(piece_scores(*own, self.table), np.unique(unit, return_index=True)[1])
            margins[new] = best + self.bias
            if len(self.hashes) + new.sum() > self.most:
                self.hashes, self.values = names[:0], margins[:0]
            every = np.concatenate([self.hashes, names[new]])
            order = np.argsort(every, kind="stable")
            self.hashes, self.values = every[order], np.concatenate([self.values, margins[new]])[order]
        return margins[place]


class Strings:
    """Units' normalised subsequence counts, as sparse rows; made and multiplied for about ``BUILT`` symbols at a time."""

    def __init__(self, code: np.ndarray, bounds: np.ndarray):
        self.n = len(bounds) - 1
        self.blocks = list(unit_blocks(bounds))
        made = [self._rows(code[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a]) for a, b in self.blocks]
        counts, numbers, values = ([x[k] for x in made] for k in range(3))
        del made
        self.starts = np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))))
        self.number = np.concatenate([np.zeros(0, np.int32), *numbers])
        del numbers
        self.value = np.concatenate([np.zeros(0, np.float32), *values])

    @staticmethod
    def _rows(code: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entries of each unit, their numbers, their values), unit by unit."""
        n = len(bounds) - 1
        unit = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))
        owners, numbers, weights = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
        for number, ok, weight in subsequences(code, bounds):
            at = np.flatnonzero(ok)
            owners.append(unit[at])
            numbers.append(number[at].astype(np.int32))
            weights.append(np.full(len(at), weight, np.float32))
        owner, number, weight = (np.concatenate(x) for x in (owners, numbers, weights))
        del owners, numbers, weights
        norm = np.maximum(np.bincount(owner, weights=weight * weight, minlength=n), 1e-12) ** (NORM / 2)
        order = np.argsort(owner, kind="stable")
        return np.bincount(owner, minlength=n), number[order], (weight / norm[owner])[order].astype(np.float32)

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[i], self.starts[i + 1]
        return self.number[a:b], self.value[a:b]

    def against(self, i: int) -> np.ndarray:
        """Kernel of every unit with unit ``i``."""
        table = np.zeros(TABLE)
        np.add.at(table, *self.row(i))
        return self.times(table)

    def own(self) -> np.ndarray:
        """Upper bound of each unit's kernel with itself (its counts' squares, repeats apart)."""
        return np.maximum(self._summed(lambda number, value: value ** 2), 1e-12)

    def times(self, table: np.ndarray) -> np.ndarray:
        return self._summed(lambda number, value: value * table[number])

    def _summed(self, of) -> np.ndarray:
        """The sum of ``of(numbers, values)`` over each unit's entries."""
        out = np.zeros(self.n)
        for a, b in self.blocks:
            own = self.starts[a:b + 1]
            owner = np.repeat(np.arange(b - a), np.diff(own))
            entries = of(self.number[own[0]:own[-1]], self.value[own[0]:own[-1]])
            out[a:b] = np.bincount(owner, weights=entries, minlength=b - a)
        return out


def pick_landmarks(strings: Strings, among: np.ndarray, worth: np.ndarray,
                   count: int) -> tuple[list[int], list[np.ndarray]]:
    """Pivoted Cholesky: each pick has the most worth that the picks so far don't explain.

    Returns the picks and their kernel with all units.
    """
    picked: list[int] = []
    kernels: list[np.ndarray] = []
    rest = strings.own()[among]
    worth = worth / rest
    factors = np.zeros((0, len(among)))
    while len(picked) < min(count, len(among)):
        k = int(np.argmax(rest * worth))
        if rest[k] * worth[k] < 1e-3 * worth.max():
            break
        column = strings.against(int(among[k]))
        kernels.append(column.astype(np.float32))
        column = column[among]
        column = (column - factors[:, k] @ factors) / np.sqrt(rest[k])
        factors = np.vstack([factors, column])
        rest = np.maximum(rest - column * column, 0)
        rest[k] = 0
        picked.append(int(among[k]))
    return picked, kernels


def hinge_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Linear machine with squared hinge loss and a bias (last weight), by Newton steps on the violators."""
    w = np.zeros(x.shape[1] + 1)
    weight = weight / weight.sum()
    keep = np.diag([ridge] * x.shape[1] + [1e-9])
    for _ in range(30):
        bad = np.flatnonzero(y * (x @ w[:-1] + w[-1]) < 1)
        left, right = keep.copy(), np.zeros(len(w))
        for a in range(0, len(bad), ROWS):
            at = bad[a:a + ROWS]
            own = np.column_stack([x[at], np.ones(len(at))]).astype(float)
            pull = own * weight[at, None]
            left += pull.T @ own
            right += pull.T @ y[at]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def logistic_curve(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the chance that y is 1, with targets drawn in as for small samples."""
    up, down = (y == 1).sum(), (y == 0).sum()
    goal = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (p - goal)) + 1e-6 * w)
        w = w - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def first_guess(code: np.ndarray, bounds: np.ndarray, toxic: list[np.ndarray], clean: list[np.ndarray]) -> np.ndarray:
    """How much each unit speaks for toxic documents: its most telling run of symbols.

    A run tells by its log odds between toxic and clean documents, times the
    root of the number of toxic documents it is in.
    """
    n = len(bounds) - 1
    out = np.zeros(n)
    for run in RUNS:
        numbers, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a, b in unit_blocks(bounds, RUN):
            own = bounds[a:b + 1] - bounds[a]
            inside = np.zeros(0, np.int64)
            for number, ok, _ in subsequences(code[bounds[a]:bounds[b]], own, [run]):
                numbers.append(number[ok].astype(np.int32))
                inside = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(own))[:len(number)][ok]
            counts.append(np.bincount(inside, minlength=b - a))
        number = np.concatenate(numbers)
        cut = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
        owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(cut))

        def spread(docs: list[np.ndarray], number=number, cut=cut) -> np.ndarray:
            seen = np.zeros(TABLE)
            for ids in docs:
                if len(ids):
                    seen[np.unique(np.concatenate([number[cut[i]:cut[i + 1]] for i in ids]))] += 1
            return seen

        in_toxic, in_clean = spread(toxic), spread(clean)
        odds = np.log((in_toxic + 0.5) / (len(toxic) + 1)) - np.log((in_clean + 0.5) / (len(clean) + 1))
        tells = np.maximum(odds, 0) * np.sqrt(in_toxic)
        tells[in_toxic < max(3, FEW * len(toxic))] = 0
        np.maximum.at(out, owner, tells[number])
    return out


def coded_units(names: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, bounds) of units stored as bytes, straight from the array's buffers."""
    if not len(names):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = names.buffers()
    bounds = np.frombuffer(offsets, np.int32)[names.offset:names.offset + len(names) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def unit_ids(bags: pa.ListArray) -> tuple[pa.BinaryArray, list[np.ndarray]]:
    """(the distinct units, each document's own ones by number) of documents as lists of units."""
    known = bags.flatten().dictionary_encode()
    ends = np.cumsum(np.diff(bags.offsets.to_numpy()))
    return known.dictionary, [np.unique(own) for own in np.split(known.indices.to_numpy(), ends[:-1])]


def fit_kernel_machine(names: pa.BinaryArray, ids: list[np.ndarray], labels: np.ndarray, weight: np.ndarray,
                       landmarks: int = LANDMARKS) -> tuple[np.ndarray, float, float, float]:
    """(table, bias, slope, offset) from units (symbols as bytes) and each document's units by number."""
    aside = np.arange(len(ids)) % 4 == 3

    def coded(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return coded_units(names.take(pa.array(which)))

    learn = [k for k in range(len(ids)) if not aside[k] and len(ids[k])]
    toxic, clean = [k for k in learn if labels[k]], [k for k in learn if not labels[k]]
    in_clean = np.bincount(np.concatenate([ids[k] for k in clean]), minlength=len(names))
    telling = first_guess(*coded(np.arange(len(names))), [ids[k] for k in toxic], [ids[k] for k in clean])
    # A run can be telling while a common word that has it is not: the word's own odds decide.
    in_toxic = np.bincount(np.concatenate([ids[k] for k in toxic]), minlength=len(names))
    odds = np.log((in_toxic + 0.5) / (len(toxic) + 1)) - np.log((in_clean + 0.5) / (len(clean) + 1))
    telling[odds < 1] = 0
    speak = np.argsort(-telling, kind="stable")[:1500]
    # A toxic document without any telling unit (labels have noise) is no example.
    toxic = [k for k in toxic if telling[ids[k]].max() > 0]
    if not toxic:
        return np.zeros(TABLE, np.float32), -1.0, 1.0, -30.0
    witnesses = [ids[k][np.argsort(-telling[ids[k]], kind="stable")[:10]] for k in toxic]
    ordinary = np.flatnonzero(in_clean)
    common = ordinary[np.argsort(-in_clean[ordinary], kind="stable")[:2000]]
    some = np.random.default_rng(5).permutation(ordinary)[:CLEAN_UNITS]
    hard = np.zeros(0, np.int64)
    table, w = np.zeros(TABLE), np.zeros(1)
    for _ in range(ROUNDS):
        negative = np.unique(np.concatenate([common, some, hard]))
        used = np.unique(np.concatenate([speak, negative, *witnesses]))
        strings = Strings(*coded(used))

        def at(which, used=used):
            return np.searchsorted(used, which)

        marks, columns = pick_landmarks(strings, at(speak), telling[speak] + 1e-9, landmarks * 5 // 8)
        plain = at(np.setdiff1d(np.concatenate([hard, common]), used[marks]))
        more = pick_landmarks(strings, plain, np.ones(len(plain)), landmarks - len(marks))
        marks, kernel = marks + more[0], np.stack(columns + more[1], axis=1)
        del columns, more
        values, vectors = np.linalg.eigh(kernel[marks].astype(float))
        good = values > 1e-6 * values.max()
        whiten = vectors[:, good] / np.sqrt(values[good])
        space = kernel @ whiten.astype(np.float32)
        del kernel
        strength = telling[used] if not w[:-1].any() else table_scores(*coded(used), table) + w[-1]
        best = np.array([x[np.argmax(strength[at(x)])] for x in witnesses])
        rows = np.concatenate([at(best), at(negative)])
        y = np.concatenate([np.ones(len(best)), -np.ones(len(negative))])
        # An ordinary unit weighs by the clean documents it would spoil, twice if it looks toxic.
        each = in_clean[negative] * np.where(np.isin(negative, hard), 2.0, 1.0) + 1.0
        each = 3 * each / each.sum()
        w = hinge_machine(space[rows], y, np.concatenate([np.full(len(best), 1 / len(best)), each]))
        table = np.zeros(TABLE)
        for m, a in zip(marks, whiten @ w[:-1], strict=True):
            number, value = strings.row(m)
            np.add.at(table, number, a * value)
        # The ordinary units that look most toxic join the next round.
        margin = table_scores(*coded(ordinary), table)
        hard = np.union1d(hard, ordinary[np.argsort(-margin, kind="stable")[:3000]])

    everything = table_scores(*coded(np.arange(len(names))), table) + w[-1]
    top = np.array([everything[i].max() if len(i) else -1.0 for i in ids])
    judge = aside if len(set(labels[aside])) == 2 else np.ones(len(ids), bool)
    slope, offset = logistic_curve(top[judge], labels[judge], weight[judge])
    return table.astype(np.float32), float(w[-1]), slope, offset


def pack_model(model) -> bytes:
    out = io.BytesIO()
    table = model[0]
    at = np.flatnonzero(table)
    np.savez(out, at=at, value=table[at], rest=np.array(model[1:]))
    return out.getvalue()


def unpack_model(data: bytes):
    with np.load(io.BytesIO(data)) as f:
        table = np.zeros(TABLE, np.float32)
        table[f["at"]] = f["value"]
        return table, *f["rest"].tolist()


def train(documents: DataFrame, labels: DataFrame, *, label: str, id_column: str, text_column: str,
          per_class: int) -> bytes | None:
    """The packed model; None without labelled documents of both classes."""
    rows = labelled_sample(documents, labels, label, [documents[text_column].alias("text")], id_column=id_column,
                           per_class=per_class)

    @lean
    def bags(batches):
        for batch in batches:
            for s in tb.slices(batch.column(3)):
                w = tb.words(s, lower=True)
                hashes, first, end, row = units(s, w)
                _, own = np.unique(tb.mix(hashes + row.astype(np.uint64)), return_index=True)
                own.sort()
                code, starts, sizes, unit = pieces(s, w, first[own], end[own])
                raw = code.tobytes()
                made = (raw[a:b] for a, b in zip(starts.tolist(), (starts + sizes).tolist(), strict=True))
                cut = np.searchsorted(row[own][unit], np.arange(s.n + 1))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).slice(s.first, s.n) for k in range(3)],
                     pa.array([list(dict.fromkeys(islice(made, k))) for k in np.diff(cut).tolist()],
                              pa.list_(pa.binary()))], names=["order", "label", "weight", "units"])

    def fit(t: pa.Table) -> bytes | None:
        y, weight = t["label"].to_numpy(), t["weight"].to_numpy()
        names, ids = unit_ids(t["units"].combine_chunks())
        del t
        give_back()
        if not {0, 1} <= {int(y[k]) for k in range(len(ids)) if len(ids[k]) and k % 4 != 3}:
            return None
        return pack_model(fit_kernel_machine(names, ids, y, weight))

    return fit_in_one_task(rows.mapInArrow(bags, "order long, label int, weight double, units array<binary>"), fit)


def strongest(s: tb.TextSlice, margins: Margins) -> tuple[np.ndarray, np.ndarray]:
    """(strongest unit's margin, number of units with a positive margin) of each row; -1 without words."""
    w = tb.words(s, lower=True)
    top, hits = np.full(s.n, -1.0), np.zeros(s.n, np.int64)
    if len(w.starts):
        hashes, first, end, row = units(s, w)
        margin = margins.of(s, w, hashes, first, end)
        full = np.unique(row, return_index=True)
        top[full[0]] = np.maximum.reduceat(margin, full[1])
        hits = np.bincount(row[margin > 0], minlength=s.n)
    return top, hits


def toxicity_scores(documents: DataFrame, labels: DataFrame, *, label: str = "toxic", id_column: str = "doc_id",
                    text_column: str = "text", per_class: int = PER_CLASS, threshold: float = THRESHOLD,
                    keep_columns: bool = False) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted, toxic_units of every row of ``documents``.

    The machine learns from at most ``per_class`` labelled rows of each class.
    Whole texts are scored.  Null, empty and blank texts have no units and
    score near 0; repeated rows score alike; without labels of both classes
    every score is 0.  An empty table gives no rows; other columns are
    ignored, or, with ``keep_columns``, all columns are returned and a
    ``__toxic_score`` is added instead.
    """
    packed = train(documents, labels, label=label, id_column=id_column, text_column=text_column, per_class=per_class)

    def scored(columns):
        """For each column of texts in turn: its slices with scores and hits."""
        model = unpack_model(packed) if packed else None
        margins = Margins(model) if model else None
        for column in columns:
            own = []
            for s in tb.slices(column):
                if model is None:
                    own.append((s, np.zeros(s.n), np.zeros(s.n, np.int64)))
                    continue
                top, hits = strongest(s, margins)
                own.append((s, 1 / (1 + np.exp(-np.clip(model[2] * top + model[3], -30, 30))), hits))
            yield own

    if keep_columns:
        # Only the texts go to Python, and only the scores come back.
        @F.arrow_udf("double")
        def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            try:
                for own in scored(columns):
                    yield pa.array(np.concatenate([np.zeros(0), *[x for _, x, _ in own]]))
            finally:
                give_back()

        return documents.withColumn("__toxic_score", score(documents[text_column]))

    @lean
    def run(batches):
        batches, again = tee(batches)
        for batch, own in zip(batches, scored(b.column(1) for b in again), strict=True):
            for s, p, hits in own:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n), pa.array(p), pa.array(hits)],
                                                 names=["doc_id", "score", "toxic_units"])

    rows = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].alias("text"))
    return (rows.mapInArrow(run, "doc_id long, score double, toxic_units long")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted"), "toxic_units"))
