"""Vectorised words, hashes and shingles over Arrow string columns.

An Arrow string column is one UTF-8 buffer with offsets; everything here
works on that buffer with numpy, in slices of about ``CHUNK`` bytes, so no
Python object is made per word and memory stays bounded by the longest
document.  Null texts have no bytes and so count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes of text handled at once; a longer document is a slice of its own
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: spreads 64-bit values, one to one."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers, the same on every machine."""
    start = U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    steps = np.arange(n, dtype=U64) * U64(0x9E3779B97F4A7C15)
    return mix(start + steps) | U64(1)


@dataclass
class TextSlice:
    """Rows ``first .. first + n`` of a column: bytes and each row's offsets into them."""

    first: int
    n: int
    data: np.ndarray
    offsets: np.ndarray


def slices(column, chunk: int = CHUNK) -> Iterator[TextSlice]:
    """The rows of a string column, in order, in slices of about ``chunk`` bytes."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    done = 0
    for part in parts:
        part = part.cast(pa.large_string()) if not pa.types.is_large_string(part.type) else part
        n = len(part)
        if not n:
            continue
        _, off, buf = part.buffers()
        offsets = np.frombuffer(off, dtype=np.int64)[part.offset:part.offset + n + 1]
        data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + chunk, side="right")) - 1
            to = min(max(to, at + 1), n)
            lo, hi = int(offsets[at]), int(offsets[to])
            yield TextSlice(done + at, to - at, data[lo:hi], offsets[at:to + 1] - lo)
            at = to
        done += n


def is_space(data: np.ndarray) -> np.ndarray:
    """The bytes of [\\x20\\x09-\\x0D]."""
    return (data == 32) | ((data >= 9) & (data <= 13))


@dataclass
class Words:
    """Words of a slice: byte range and hash of each; ``bounds[d]:bounds[d + 1]`` are row d's."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit multilinear hash of each byte range (ranges in order, not overlapping, not empty)."""
    if not len(starts):
        return np.zeros(0, U64)
    lens = ends - starts
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    place = np.arange(int(lens.sum())) - np.repeat(first, lens)
    values = data[place + np.repeat(starts, lens)].astype(U64) + U64(1)
    values *= constants(int(lens.max()), seed)[place]
    return mix(np.add.reduceat(values, first) ^ (lens.astype(U64) << U64(40)))


def words(s: TextSlice, lower: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every row; ``lower`` folds A-Z only."""
    data, offsets = s.data, s.offsets
    n = len(data)
    solid = np.zeros(n + 1, bool)
    solid[:n] = ~is_space(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge))
    ends = np.flatnonzero(before & (~solid | edge))
    hashes = run_hashes(lower_ascii(data) if lower else data, starts, ends)
    return Words(starts, ends, hashes, np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of each run of ``k`` hashes (as many runs as fit; row borders are the caller's)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    m = constants(k, seed)
    total = hashes[:n] * m[0]
    for j in range(1, k):
        total = total + hashes[j:j + n] * m[j]
    return mix(total)


def shingle_sets(w: Words, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of every row, ascending, and the rows' bounds.

    A row with fewer than k words (and at least one) has its whole sequence
    as its one shingle; a row without words has none.
    """
    all_runs = windows(w.hashes, k, seed)
    m = constants(k, seed)
    out, sizes = [], np.zeros(len(w.bounds) - 1, np.int64)
    for d in range(len(sizes)):
        a, b = int(w.bounds[d]), int(w.bounds[d + 1])
        if b - a >= k:
            own = np.unique(all_runs[a:b - k + 1])
        elif b > a:
            own = mix((w.hashes[a:b] * m[:b - a]).sum(keepdims=True) + U64(b - a))
        else:
            continue
        sizes[d] = len(own)
        out.append(own)
    flat = np.concatenate(out) if out else np.zeros(0, U64)
    return flat, np.concatenate(([0], np.cumsum(sizes)))
