"""Hierarchical packing into several context sizes (operator 10).

Each partition tokenises its own documents and packs them in blocks of
about ``BLOCK`` ids: no shuffle, bounded memory, the same result when a
task runs again.  In a block:

1. Full windows of the longest tier are cut off every document; what is left
   is routed to the shortest tier that holds it.
2. Each tier, longest first, opens a window for its longest waiting piece and
   fills the gap with the longest waiting piece of this or a shorter tier
   that fits, again and again.
3. A gap that no whole piece fits is closed by cutting the shortest longer
   one; the cut-off rest is routed again.  So every window but a block's
   last is exactly full, and a window has a tier's size.
4. Windows are dealt to step groups, largest first, each to the group with
   the fewest ids so far: groups hold about ``step_tokens`` ids each.

Only a block's last window can need padding (to the longest tier).
"""

from __future__ import annotations

import heapq
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loadkit.llm.bfd_packing import BLOCK, blocks
from loadkit.llm.lean import lean
from loadkit.llm.tokens import VOCABULARY

TIERS = (256, 512, 1024, 2048)
END_ID = 1
STEP_TOKENS = 16 * 2048

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, tier int, step_group long")


class Waiting:
    """Pieces (item, start) by length, with the set of lengths kept as the bits of one number."""

    def __init__(self, width: int):
        self.by_length: list[list[tuple[int, int]]] = [[] for _ in range(width + 1)]
        self.lengths = 0

    def add(self, item: int, start: int, length: int) -> None:
        self.by_length[length].append((item, start))
        self.lengths |= 1 << length

    def longest(self, most: int) -> int:
        """The longest length of ``most`` or less; 0 if none."""
        return max((self.lengths & ((1 << (most + 1)) - 1)).bit_length() - 1, 0)

    def shortest_over(self, length: int) -> int:
        above = self.lengths >> (length + 1)
        return (above & -above).bit_length() + length if above else 0

    def pop(self, length: int) -> tuple[int, int]:
        piece = self.by_length[length].pop()
        if not self.by_length[length]:
            self.lengths &= ~(1 << length)
        return piece


def tier_windows(lengths: list[int], tiers: tuple[int, ...]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (tier, [(item, start, length)]).  All are full but, at most, the last."""
    widest = tiers[-1]
    windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    waiting = Waiting(widest)
    for item, n in enumerate(lengths):
        cut = n - n % widest
        windows.extend((widest, [(item, s, widest)]) for s in range(0, cut, widest))
        if n > cut:
            waiting.add(item, cut, n - cut)
    while waiting.lengths:
        n = waiting.longest(widest)
        tier = next(t for t in tiers if t >= n)
        own, gap = [(*waiting.pop(n), n)], tier - n
        while gap and waiting.lengths:
            if n := waiting.longest(gap):
                own.append((*waiting.pop(n), n))
                gap -= n
                continue
            n = waiting.shortest_over(gap)
            item, start = waiting.pop(n)
            own.append((item, start, gap))
            waiting.add(item, start + gap, n - gap)
            gap = 0
        windows.append((tier, own))
    return windows


def step_groups(windows, step_tokens: int) -> list[int]:
    """A group for each window; the groups' id counts differ by one window at most."""
    used = [sum(n for _, _, n in own) for _, own in windows]
    heap = [(0, g) for g in range(max(1, -(-sum(used) // step_tokens)))]
    group = [0] * len(windows)
    for k in sorted(range(len(windows)), key=lambda k: (-used[k], k)):
        tokens, g = heap[0]
        heapq.heapreplace(heap, (tokens + used[k], g))
        group[k] = g
    return group


def pack_tiers(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
               tiers: tuple[int, ...] = TIERS, vocabulary: str = VOCABULARY, end_id: int = END_ID,
               step_tokens: int = STEP_TOKENS, block: int = BLOCK) -> DataFrame:
    """One row per piece of a document in a window.

    ``doc_id``, ``start`` (the document's ids before the piece), ``length``,
    ``ids_crc32`` (of the piece's ids as little-endian unsigned 32-bit
    numbers), ``doc_tokens`` (ids of the document with the closing id),
    ``sequence_id``, ``offset`` in it, ``tier`` (its size), ``step_group``.

    Null and empty texts have the closing id alone.  Repeated rows and ids
    are packed as often as they come (each row's pieces start at 0); a null
    id stays null.  Ties go by input order.  An empty table gives no rows,
    other columns are ignored, and a text of any length is cut into windows.
    """
    tiers = tuple(sorted(tiers))

    @lean
    def pack(batches):
        sequence = step = TaskContext.get().partitionId() << 32
        for docs, ids in blocks(batches, vocabulary, end_id, block):
            windows = tier_windows([len(x) for x in ids], tiers)
            groups = step_groups(windows, step_tokens)
            rows = []
            for k, (tier, own) in enumerate(windows):
                offset = 0
                for item, start, n in own:
                    crc = zlib.crc32(ids[item][start:start + n].tobytes())
                    rows.append((docs[item], start, n, crc, len(ids[item]), sequence + k, offset, tier,
                                 step + groups[k]))
                    offset += n
            sequence += len(windows)
            step += max(groups) + 1
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                             names=names)

    picked = documents.select(documents[id_column].cast("long"), documents[text_column])
    return picked.mapInArrow(pack, SCHEMA)
