"""Token-ID output: best-fit-decreasing packing into fixed-width id matrices (operator 2).

Each partition tokenises its own documents and packs them in blocks of
about ``BLOCK`` ids, so there is no shuffle and memory is bounded.  A
document longer than a row is split, without loss, into full rows and a
rest.  Rests and short documents go, longest first, to the open row with the
least room that still holds them; a segment tree over room sizes finds it.

One output row per packed sequence:

- ``sequence_id`` long, unique; ``n_tokens`` int, ids before the padding
- ``ids`` binary: ``width`` little-endian unsigned numbers (16 bits if the
  vocabulary allows, else 32), padded with ``pad_id``
- ``cu_seqlens`` array<int>: 0 and the running total of segment lengths
- ``positions`` binary, unsigned 16 or 32 bits: position within the segment,
  starting again at 0 with each segment and with the padding
- ``doc_ids`` array<long>, ``starts`` array<long>: document and first id of
  each segment

Null and empty texts are one segment of the closing id alone.  Repeated
rows and ids are packed as often as they come; a null id stays null.  An
empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loadkit.llm.lean import lean
from loadkit.llm.tokens import VOCABULARY, encode, encoder

WIDTH = 2048
END_ID = 50256  # closes each document and fills the padding
BLOCK = 1 << 22  # ids packed together


class RoomTree:
    """Open rows by room left.  ``take(n)`` gives a row with the least room of n or more."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.counts = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        i = room + self.size
        while i:
            self.counts[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, its room), removed from the tree; None if no open row has the room."""
        counts, i = self.counts, need + self.size
        while not counts[i]:  # climb to the nearest subtree of larger rooms that has rows
            while i > 1 and (i & 1 or not counts[i + 1]):
                i >>= 1
            if i == 1:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if counts[2 * i] else 2 * i + 1
        room = i - self.size
        row = self.rows[room].pop()
        while i:
            counts[i] -= 1
            i >>= 1
        return row, room


def best_fit_rows(lengths: list[int], width: int) -> list[list[tuple[int, int, int]]]:
    """Rows of (item, start, length).  Every item is whole in one row, or cut into full rows and a rest."""
    rows: list[list[tuple[int, int, int]]] = []
    rests = []
    for item, n in enumerate(lengths):
        full = n // width
        rows.extend([(item, k * width, width)] for k in range(full))
        if n % width:
            rests.append((n % width, item, full * width))
    tree = RoomTree(width)
    rests.sort(key=lambda r: (-r[0], r[1]))
    for n, item, start in rests:
        found = tree.take(n)
        if found is None:
            row, room = len(rows), width
            rows.append([])
        else:
            row, room = found
        rows[row].append((item, start, n))
        if room - n:
            tree.add(row, room - n)
    return rows


SCHEMA = ("sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, "
          "doc_ids array<long>, starts array<long>")


def blocks(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int,
           block: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Documents' ids and token ids, in blocks of about ``block`` token ids."""
    enc = encoder(vocabulary)
    docs, ids, total = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = encode(enc, text.as_py(), end_id)
            docs.append(doc)
            ids.append(own)
            total += len(own)
            if total >= block:
                yield docs, ids
                docs, ids, total = [], [], 0
    if docs:
        yield docs, ids


def pack_best_fit(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
                  width: int = WIDTH, vocabulary: str = VOCABULARY, vocabulary_size: int = 50257,
                  end_id: int = END_ID, pad_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """Packed id rows of ``documents``; see the module's text for the columns."""
    id_kind = "<u2" if max(vocabulary_size - 1, end_id, pad_id) < 1 << 16 else "<u4"
    place_kind = "<u2" if width <= 1 << 16 else "<u4"

    @lean
    def pack(batches):
        count = TaskContext.get().partitionId() << 32
        ramp = np.arange(width, dtype=place_kind)
        for docs, ids in blocks(batches, vocabulary, end_id, block):
            rows = best_fit_rows([len(x) for x in ids], width)
            for at in range(0, len(rows), 1024):
                some = rows[at:at + 1024]
                out = {k: [] for k in ("n", "ids", "cu", "place", "docs", "starts")}
                for row in some:
                    line = np.full(width, pad_id, dtype=id_kind)
                    place, cu = ramp.copy(), [0]
                    for item, start, n in row:
                        line[cu[-1]:cu[-1] + n] = ids[item][start:start + n]
                        place[cu[-1]:cu[-1] + n] = ramp[:n]
                        cu.append(cu[-1] + n)
                    place[cu[-1]:] = ramp[:width - cu[-1]]
                    out["n"].append(cu[-1])
                    out["ids"].append(line.tobytes())
                    out["cu"].append(cu)
                    out["place"].append(place.tobytes())
                    out["docs"].append([docs[item] for item, _, _ in row])
                    out["starts"].append([start for _, start, _ in row])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(count, count + len(some)), pa.int64()), pa.array(out["n"], pa.int32()),
                     pa.array(out["ids"], pa.binary()), pa.array(out["cu"], pa.list_(pa.int32())),
                     pa.array(out["place"], pa.binary()), pa.array(out["docs"], pa.list_(pa.int64())),
                     pa.array(out["starts"], pa.list_(pa.int64()))],
                    names=["sequence_id", "n_tokens", "ids", "cu_seqlens", "positions", "doc_ids", "starts"])
                count += len(some)

    picked = documents.select(documents[id_column].cast("long"), documents[text_column])
    return picked.mapInArrow(pack, SCHEMA)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write the packed rows as parquet: column ``ids`` read in file order is the id matrix."""
    packed.write.parquet(path)
