"""Document fingerprints by one-permutation MinHash (operator 8).

Every word shingle is hashed once.  The hash's top bits choose one of
``BINS`` bins, whose smallest hash stands for it; its low ``BITS`` bits are
kept.  Empty bins borrow from a full one by optimal densification: each bin
has its own fixed sequence of bins to try, the same for all documents, and
takes the first that is full.  The fingerprint is the packed bits.  Likeness
is the share of equal bins, corrected for equality by chance.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadkit.llm import textbatch as tb
from loadkit.llm.bbit import agreement
from loadkit.llm.graph import kept
from loadkit.llm.lean import lean

BINS, BITS = 256, 4
WORDS = 5


def bin_minima(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest hash, full) matrices, rows by bins, of ascending distinct hashes with row bounds."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    place = row * BINS + (flat >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.concatenate(([True], place[1:] != place[:-1])) if len(place) else np.zeros(0, bool)
    least = np.zeros(n * BINS, np.uint64)
    full = np.zeros(n * BINS, bool)
    least[place[first]] = flat[first]
    full[place[first]] = True
    return least.reshape(n, BINS), full.reshape(n, BINS)


def densify(least: np.ndarray, full: np.ndarray) -> None:
    """Fill the empty bins of every row that has a full one, in place."""
    rows, bins = np.nonzero(~full & full.any(axis=1, keepdims=True))
    attempt = 0
    while len(rows):
        tried = tb.mix(bins.astype(np.uint64) * np.uint64(1 << 32) + np.uint64(attempt))
        source = (tried >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
        hit = full[rows, source]
        least[rows[hit], bins[hit]] = least[rows[hit], source[hit]]
        rows, bins = rows[~hit], bins[~hit]
        attempt += 1


def signatures(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Packed low bits of each row, (rows, BINS * BITS / 64) of 64 bits; for rows with hashes.

    A bin's hash is mixed with the bin's number before its bits are taken, so
    that two different hashes that fill many bins agree by chance in each bin
    on its own, as the correction assumes.
    """
    least, full = bin_minima(flat, bounds)
    densify(least, full)
    low = tb.mix(least + tb.constants(BINS, 31)) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    shifts = np.arange(per, dtype=np.uint64) * np.uint64(BITS)
    return (low.reshape(len(low), BINS // per, per) << shifts).sum(axis=2)


def text_signatures(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, number of shingles) of a text column."""
    sigs, sizes = [np.zeros((0, BINS * BITS // 64), np.uint64)], [np.zeros(0, np.int64)]
    for s in tb.slices(column):
        flat, bounds = tb.shingle_sets(tb.words(s, lower=True), words)
        sigs.append(signatures(flat, bounds))
        sizes.append(np.diff(bounds))
    return np.concatenate(sigs), np.concatenate(sizes)


def _column(sigs: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """array<long>, empty for texts without words."""
    full = sizes > 0
    ends = np.concatenate(([0], np.cumsum(full))) * sigs.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)),
                                    pa.array(np.ascontiguousarray(sigs[full]).view(np.int64).ravel()))


def _likeness(x: str, y: str):
    """0 to 1; texts without words are alike to each other and to nothing else."""
    close = F.greatest(F.lit(0.0), F.least(F.lit(1.0), agreement(x, y, BINS, BITS)))
    none_x, none_y = F.size(x) == 0, F.size(y) == 0
    return F.when(none_x & none_y, 1.0).when(none_x | none_y, 0.0).otherwise(close)


def _hex(x: str):
    return F.array_join(F.transform(x, lambda v: F.lower(F.lpad(F.hex(v), 16, "0"))), "")


def fingerprints(documents: DataFrame, *, text_column: str = "text", words: int = WORDS,
                 fingerprint_column: str = "fingerprint") -> DataFrame:
    """``documents`` (all columns) with each text's fingerprint: lowercase hex, empty without words."""
    schema = T.StructType([*documents.schema, T.StructField("__signature", T.ArrayType(T.LongType()))])

    @lean
    def run(batches):
        for batch in batches:
            sigs, sizes = text_signatures(batch.column(batch.schema.names.index(text_column)), words)
            yield pa.RecordBatch.from_arrays([*batch.columns, _column(sigs, sizes)],
                                             names=[*batch.schema.names, "__signature"])

    return (documents.mapInArrow(run, schema)
            .withColumn(fingerprint_column, _hex("__signature")).drop("__signature"))


def followers(ids: DataFrame) -> DataFrame:
    """(id, next_id, need) from rows (id, need): the next greater id, after the last the first.

    ``need`` is the largest of an id's rows.  Null counts as the smallest id.
    The ids are sorted in ranges; only each range's first id is looked at
    across ranges.
    """
    per = ids.groupBy("id").agg(F.max("need").alias("need"))
    ranged = kept(per.repartitionByRange("id").withColumn("range", F.spark_partition_id()), "follow-ranges")
    inside = ranged.withColumn("row", F.struct("id")).withColumn(
        "next", F.lead("row").over(Window.partitionBy("range").orderBy("id")))
    heads = ranged.groupBy("range").agg(F.min(F.struct("id")).alias("head"))
    first = Window.orderBy("range")
    after = heads.select("range", F.coalesce(F.lead("head").over(first), F.first("head").over(first)).alias("after"))
    return (inside.join(after, "range")
            .select("id", F.coalesce("next", "after")["id"].alias("next_id"), "need"))


def _signed(documents: DataFrame, words: int) -> DataFrame:
    """(id, n_chars, own signature, order, packed text) of rows (id, text): one pass over the texts.

    Texts travel packed (zstd): a shuffle of them is half as large.
    """
    @lean
    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = batch.column(1)
            raw = [x.as_py().encode() for x in texts]
            order = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.utf8_length(texts).cast(pa.int64()), _column(*text_signatures(texts, words)),
                 pa.array(order, pa.int64()), pa.array([pack.compress(x) for x in raw], pa.binary())],
                names=["id", "n_chars", "own", "order", "packed"])

    return documents.mapInArrow(run, "id long, n_chars long, own array<long>, order long, packed binary")


def _starts(rows: DataFrame) -> DataFrame:
    """(previous, order, start, next_own) of rows (previous, need, order, packed, own, ...).

    ``start`` is the packed first ``need`` characters.
    """
    @lean
    def run(batches):
        pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for batch in batches:
            made = [pack.compress(unpack.decompress(x.as_py()).decode()[:n].encode())
                    for n, x in zip(batch.column(1).to_pylist(), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(made, pa.binary()), batch.column(4)],
                names=["previous", "order", "start", "next_own"])

    return rows.mapInArrow(run, "previous long, order long, start binary, next_own array<long>")


def edited_report(documents: DataFrame, *, words: int = WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter is the next document's start.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  Null texts are empty.  Rows that share an id have
    one next document; if that one's id has several rows, one of them counts,
    the same on every run (smallest hash of the text).  A null id is the
    smallest id.  An empty table gives no rows; other columns are ignored.

    The texts are shuffled once: the exchange by id serves both the join that
    cuts the starts and the join that puts them to the documents before.
    """
    docs = documents.select(documents["doc_id"].cast("long").alias("id"),
                            F.coalesce(documents["text"], F.lit("")).alias("text"))
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    follow = kept(followers(docs.select("id", quarter.alias("need"))), "follow")

    # Keys are structs: as such, null ids are equal, and one partitioning serves groups and joins.
    signed = _signed(docs, words).withColumn("key", F.struct("id"))
    after = follow.select(F.col("id").alias("previous"), "need", F.struct(F.col("next_id").alias("id")).alias("key"))
    # Both joins take the same columns of ``signed``, so that Spark reuses its exchange.
    starts = (_starts(signed.join(after, "key").select("previous", "need", "order", "packed", "own", "id", "n_chars"))
              .groupBy(F.struct(F.col("previous").alias("id")).alias("key"))
              .agg(F.min_by(F.struct("start", "next_own"), "order").alias("next")))
    both = signed.join(starts, "key", "left").select("id", "n_chars", "own", "order", "packed", "next.start",
                                                     "next.next_own")

    @lean
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            edited = []
            for n, text, start in zip(batch.column(1).to_pylist(), batch.column(4), batch.column(5), strict=True):
                start = start.as_py()
                text = unpack.decompress(text.as_py()).decode()
                start = unpack.decompress(start).decode()[:n // 4] if start is not None else text[n - n // 4:]
                edited.append(text[:n - n // 4] + start)
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in edited]
            new = _column(*text_signatures(pa.array(edited, pa.large_string()), words))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], pa.array(sha), new, batch.column(6)],
                                             names=["id", "n_chars", "own", "edited_sha256", "new", "next_own"])

    out = both.mapInArrow(run, "id long, n_chars long, own array<long>, edited_sha256 string, new array<long>, "
                               "next_own array<long>")
    return out.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", _hex("own").alias("fingerprint"),
                      _hex("new").alias("edited_fingerprint"), _likeness("own", "new").alias("near_edited"),
                      _likeness("own", "next_own").alias("near_next"))
