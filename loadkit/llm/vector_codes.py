"""Vector code compression by member-resident Lloyd rounds (operator 13).

Vectors of whole numbers are cut into ``PARTS`` equal parts; each part
position has a codebook of up to ``ENTRIES`` entries, and a vector's code
names the nearest entry of each of its parts.  Codebooks are improved by
Lloyd rounds, for which the parts themselves live with the entry they belong
to:

1. Every part goes once, packed in blocks, to the owner of its (position,
   entry, salt).  An entry that holds many parts has several owners, told by
   the salt, so none holds more than about ``MEMBERS`` if one entry holds all.
2. Owners add up their resident members; the sums, one row for each entry
   and place, make the next codebook.
3. Owners look for each member's nearest entry in it.  Members that stay are
   written where they are; only those that change their entry are shuffled to
   the new owner, when the next round reads both.

Only codebooks, of fixed size, come to the driver.  Owners are written tables
in the shared folder, so a lost executor costs its tasks.  The codes
themselves come from a scan of the vectors with the last codebooks.

All arithmetic is on 64-bit whole numbers.  Components are held between -LIMIT
and LIMIT (32,768 before scaling), which keeps every sum exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadkit.llm.graph import BROADCAST_IDS, kept
from loadkit.llm.lean import lean

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 1 << 23
MEMBERS = 1 << 18  # parts an owner holds, about, when one entry holds all
ROWS = 1 << 12  # parts compared with a codebook at a time

BLOCKS = "pos int, entry int, salt int, moved boolean, members binary"
SUMS = "pos int, entry int, place int, members long, total long"


def usable(vectors: DataFrame, vector_column: str) -> Column:
    """Vectors that are not null and hold only finite numbers."""
    v = vectors[vector_column].cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(False))


def scaled(vectors: DataFrame, vector_column: str) -> Column:
    """Components as whole numbers, rounded down."""
    def whole(x: Column) -> Column:
        return F.floor(F.greatest(F.least(x * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int")

    return F.transform(vectors[vector_column].cast("array<double>"), whole)


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The vectors as rows of ``PARTS * width`` numbers; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy()
    out = np.zeros((len(column), PARTS * width), np.int32)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(column)), sizes)
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = flat[offsets[0]:offsets[-1]]
    return out


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row of ``parts``; of equal distances the lower entry."""
    entry, far = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    for a in range(0, len(parts), ROWS):
        own = parts[a:a + ROWS].astype(np.int64)
        total = np.zeros((len(own), len(book)), np.int64)
        for k in range(own.shape[1]):
            off = own[:, k, None] - book[None, :, k]
            off *= off
            total += off
        entry[a:a + ROWS] = total.argmin(axis=1)
        far[a:a + ROWS] = total.min(axis=1)
    return entry, far


def packed(pos: int, parts: np.ndarray, entry: np.ndarray, salt: int, moved: np.ndarray):
    """Blocks (pos, entry, salt, moved, members) of one position's parts, those that moved apart."""
    key = entry * 2 + moved
    order = np.argsort(key, kind="stable")
    names, first = np.unique(key[order], return_index=True)
    for name, own in zip(names.tolist(), np.split(order, first[1:]), strict=True):
        yield pos, name // 2, salt, bool(name % 2), parts[own].astype("<i4").tobytes()


def block_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = {"pos": pa.int32(), "entry": pa.int32(), "salt": pa.int32(), "moved": pa.bool_(), "members": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))


def first_owners(vectors: DataFrame, books: np.ndarray, salts: int) -> DataFrame:
    """Blocks of all parts under the first codebooks; ``vectors`` has one column of whole numbers and a salt."""
    width = books.shape[2]

    @lean
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, salt = matrix(batch.column(0), width), batch.column(1).to_numpy()
            # A batch's rows are spread over the salts by runs of rows: all its blocks stay large.
            own = int(salt[0]) % salts
            rows = []
            for pos in range(PARTS):
                parts = x[:, pos * width:(pos + 1) * width]
                entry, _ = nearest(parts, books[pos])
                rows.extend(packed(pos, parts, entry, own, np.ones(len(parts), bool)))
            yield block_batch(rows)

    return vectors.mapInArrow(run, BLOCKS)


def by_position(batch: pa.RecordBatch, width: int):
    """(position, parts, entries, salt) of a batch of blocks."""
    pos, entry, salt = (batch.column(k).to_numpy() for k in range(3))
    members = batch.column(4)
    for p in np.unique(pos).tolist():
        at = np.flatnonzero(pos == p)
        raw = [members[k].as_buffer() for k in at.tolist()]
        sizes = np.array([r.size for r in raw]) // (4 * width)
        parts = np.concatenate([np.frombuffer(r, "<i4") for r in raw]).reshape(-1, width)
        yield p, parts, np.repeat(entry[at], sizes), int(salt[at].min())


def member_sums(owners: DataFrame, width: int) -> DataFrame:
    """Each entry's members and the sums of their places: added up in each task, then over the tasks."""
    @lean
    def run(batches):
        count = np.zeros((PARTS, ENTRIES), np.int64)
        total = np.zeros((PARTS, ENTRIES, width), np.int64)
        for batch in batches:
            for p, parts, entry, _ in by_position(batch, width):
                count[p] += np.bincount(entry, minlength=ENTRIES)
                for a in range(0, len(parts), ROWS):
                    np.add.at(total[p], entry[a:a + ROWS], parts[a:a + ROWS])
        pos, entry = np.nonzero(count)
        rows = len(pos)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(pos, width), pa.int32()), pa.array(np.repeat(entry, width), pa.int32()),
                 pa.array(np.tile(np.arange(width), rows), pa.int32()),
                 pa.array(np.repeat(count[pos, entry], width)), pa.array(total[pos, entry].ravel())],
                names=["pos", "entry", "place", "members", "total"])

    return (owners.mapInArrow(run, SUMS).groupBy("pos", "entry", "place")
            .agg(F.sum("members").alias("members"), F.sum("total").alias("total")))


def next_books(owners: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each used entry becomes its members' mean, rounded down; collects a row for each number of the codebooks."""
    out = books.copy()
    for r in member_sums(owners, books.shape[2]).collect():
        out[r.pos, r.entry, r.place] = r.total // r.members
    return out


def reassigned(owners: DataFrame, books: np.ndarray) -> DataFrame:
    """The owners' members under new codebooks, as blocks; those that change their entry are marked as moved."""
    width = books.shape[2]

    @lean
    def run(batches):
        for batch in batches:
            rows = []
            for p, parts, entry, salt in by_position(batch, width):
                found, _ = nearest(parts, books[p])
                rows.extend(packed(p, parts, found, salt, found != entry))
            if rows:
                yield block_batch(rows)

    return owners.mapInArrow(run, BLOCKS)


def arrived(blocks: DataFrame, label: str) -> DataFrame:
    """Blocks shuffled to their owners, as a written table."""
    return kept(blocks.repartition("pos", "entry", "salt"), label)


def settled(blocks: DataFrame, label: str) -> DataFrame:
    """Blocks with their owners: those that moved are shuffled there, the others stay in their files."""
    written = kept(blocks, label)
    return written.filter("not moved").unionByName(arrived(written.filter("moved"), f"{label}-arrived"))


def first_books(rows: list[list[int]], width: int) -> np.ndarray:
    """(position, entry, place) from the vectors that the codebooks start as."""
    out = np.zeros((len(rows), PARTS * width), np.int64)
    for k, v in enumerate(rows):
        out[k, :len(v)] = v
    return np.ascontiguousarray(out.reshape(len(rows), PARTS, width).transpose(1, 0, 2))


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def train_books(whole: DataFrame, rows: int, width: int, start: list[list[int]], rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (position, entry, place) after ``rounds`` rounds from the parts of the vectors ``start``."""
    books = first_books(start, width)
    salts = -(-rows // MEMBERS)
    spread = F.pmod(F.spark_partition_id() * 7919 + F.floor(F.monotonically_increasing_id() % (1 << 33) / 10_000),
                    F.lit(salts)).cast("int")
    if not rounds:
        return books
    owners = arrived(first_owners(whole.select("whole", spread.alias("salt")), books, salts), "vector-owners-0")
    books = next_books(owners, books)
    for k in range(1, rounds):
        owners = settled(reassigned(owners, books), f"vector-owners-{k}")
        books = next_books(owners, books)
    return books


def compress_vectors(vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding",
                     label_column: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row of ``vectors``.

    Rows whose vector is null or holds null or non-finite components have no
    code and are left out.  Codebooks start as the vectors of the smallest
    ids (ties: by the vector; a null id is largest); fewer usable rows than
    ``ENTRIES`` make fewer entries.  Vectors shorter than the longest, and
    lengths that the parts don't divide, are filled up with zeros.  Repeated
    rows get equal codes.  ``label_error`` adds up the errors of a label; null
    labels are one.  Without usable rows there are no rows.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    label_type = vectors.schema[label_column].dataType
    whole = (vectors.filter(usable(vectors, vector_column))
             .select(vectors[id_column].cast("long").alias("vec_id"), vectors[label_column].alias("label"),
                     scaled(vectors, vector_column).alias("whole")))
    known = whole.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("whole")).alias("size")).first()
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if not known["n"]:
        return spark.createDataFrame([], schema)
    width = max(-(-known["size"] // PARTS), 1)
    start = whole.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(ENTRIES).select("whole").collect()
    books = train_books(whole, known["n"], width, [r["whole"] for r in start], rounds)

    @lean
    def code(batches):
        for batch in batches:
            x = matrix(batch.column(2), width)
            codes, error = np.empty((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
            for pos in range(PARTS):
                codes[:, pos], far = nearest(x[:, pos * width:(pos + 1) * width], books[pos])
                error += far
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()),
                 pa.array(error)], names=["vec_id", "label", "code", "error"])

    coded = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label_type),
                          T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    rows = kept(whole.mapInArrow(code, coded), "vector-codes")
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    if sums.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        sums = F.broadcast(sums)
    return (rows.join(sums, rows["label"].eqNullSafe(sums["of"]))
            .select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")))


def _assigned(name: str, book: str) -> str:
    return f"""{name} AS (
  SELECT rid, pos, best % 64 AS entry, best // 64 AS far FROM (
    SELECT p.rid, p.pos, min(64 * list_sum(list_transform(range(1, len(p.v) + 1),
      lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i]))) + b.entry)::BIGINT AS best
    FROM p JOIN {book} b ON p.pos = b.pos GROUP BY ALL))"""


def _updated(name: str, book: str, assigned: str) -> str:
    return f"""{name}_mean AS (
  SELECT pos, entry, list(mean ORDER BY place) AS v FROM (
    SELECT a.pos, a.entry, place, floor(sum(p.v[place])::DECIMAL(38, 0) / count(*))::BIGINT AS mean
    FROM {assigned} a JOIN p USING (rid, pos), range(1, (SELECT max(len(v)) FROM p) + 1) t(place) GROUP BY ALL)
  GROUP BY ALL),
{name} AS (SELECT b.pos, b.entry, coalesce(m.v, b.v) AS v FROM {book} b LEFT JOIN {name}_mean m USING (pos, entry))"""


SQL = f"""
WITH q AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rid, vec_id, label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT rid, pos, v[pos * (len(v) // 16) + 1:(pos + 1) * (len(v) // 16)] AS v FROM q, range(16) t(pos)),
b0 AS (SELECT pos, rid AS entry, v FROM p WHERE rid < 64),
{_assigned("a0", "b0")},
{_updated("b1", "b0", "a0")},
{_assigned("a1", "b1")},
{_updated("b2", "b1", "a1")},
{_assigned("a2", "b2")},
r AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, sum(far)::BIGINT AS error
      FROM a2 GROUP BY rid),
l AS (SELECT label, sum(error)::BIGINT AS label_error FROM r JOIN q USING (rid) GROUP BY label),
s AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY pos, entry, place)) AS codebooks_sha256
      FROM (SELECT pos, entry, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM b2))
SELECT q.vec_id, r.code, r.error, l.label_error, s.codebooks_sha256
FROM r JOIN q USING (rid) JOIN l ON q.label IS NOT DISTINCT FROM l.label, s
"""
