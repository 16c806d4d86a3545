"""Near-duplicate classes by b-bit MinHash (operator 6).

1. One pass over the documents makes, for every text, its set of word
   shingles, a digest of the set, ``BANDS`` keys of ``ROWS`` minima each, and
   a sketch: the low ``BITS`` bits of the minima, packed in 64-bit numbers.
2. Equal sets collapse to one class, named by its smallest document id.
3. Classes that share a band key are candidates.  Each is first compared
   with the smallest member of its buckets, so a large group of near copies
   costs one comparison per member and hangs together afterwards.  Then,
   only in buckets whose members still lie in different components, members
   outside the smallest one's component are compared with the others: as
   pairs in small buckets, in blocks in large ones.
4. A comparison counts equal low bits by ``bit_count``, corrects for chance
   matches (2**-BITS), and drops pairs far below the similarity; the rest
   are confirmed on the full sets.
5. Connected components of the confirmed links.

A pair at similarity 0.8 misses all 40 bands of 5 with probability
(1 - 0.8**5)**40 = 1.3e-7; the sketch's margin is about six standard errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadkit.llm import textbatch as tb
from loadkit.llm.bbit import agreement
from loadkit.llm.graph import components, kept, some_ids
from loadkit.llm.lean import lean

BANDS, ROWS, BITS = 40, 5, 4
SKETCHED = 192  # minima whose low bits the sketch keeps
MARGIN = 0.17  # how far below the similarity a sketch may estimate a true link
PAIRED = 16  # members of a bucket that are compared as rows of pairs; more are compared in blocks
BLOCK = 1 << 21  # shingles in a block
NO_ID = 1 << 62  # rows without an id are named by numbers from here on


def _named(ids, keys: list[bytes]) -> list[int]:
    return [i if i is not None else NO_ID | (int.from_bytes(k[:8], "little") & (NO_ID - 1))
            for i, k in zip(ids, keys, strict=True)]


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, list[bytes]]]:
    """(ids, flat shingle hashes, bounds, set digests) of slices of a batch of (id, text)."""
    for s in tb.slices(batch.column(1)):
        flat, bounds = tb.shingle_sets(tb.words(s, lower=True), k)
        keys = [hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() if b > a else b""
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield batch.column(0).slice(s.first, s.n).to_pylist(), flat, bounds, keys


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)),
                                    pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))


SKETCH_SCHEMA = "doc_id long, node long, n long, class binary, keys array<long>, sketch array<long>"


def sketches(documents: DataFrame, k: int) -> DataFrame:
    """One row per row of ``documents`` (id, text): see SKETCH_SCHEMA; no words: class is null."""
    n_hash = BANDS * ROWS
    per_word = 64 // BITS

    @lean
    def run(batches):
        a = (tb.constants(n_hash, 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        b = (tb.constants(n_hash, 12) >> np.uint64(32)).astype(np.uint32)
        join, salt = tb.constants(ROWS, 13), tb.constants(BANDS, 14)
        shifts = (np.arange(per_word, dtype=np.uint64) * np.uint64(BITS))
        for batch in batches:
            for ids, flat, bounds, keys in _sets(batch, k):
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                least = np.zeros((n_hash, len(full)), np.uint32)
                if len(full):
                    small = (flat >> np.uint64(32)).astype(np.uint32)
                    for j in range(n_hash):
                        least[j] = np.minimum.reduceat(small * a[j] + b[j], bounds[full])
                bands = (least.reshape(BANDS, ROWS, -1).astype(np.uint64) * join[:, None]).sum(axis=1)
                bands = tb.mix(bands + salt[:, None]).T
                low = (least[:SKETCHED] & np.uint32((1 << BITS) - 1)).astype(np.uint64)
                sketch = (low.reshape(SKETCHED // per_word, per_word, len(full)) << shifts[:, None]).sum(axis=1).T
                filled = np.concatenate(([0], np.cumsum(sizes > 0)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(_named(ids, keys), pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array([x or None for x in keys], pa.binary()),
                     _lists(bands, filled * BANDS), _lists(sketch, filled * (SKETCHED // per_word))],
                    names=["doc_id", "node", "n", "class", "keys", "sketch"])

    return documents.mapInArrow(run, SKETCH_SCHEMA)


def shingle_table(documents: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the rows of ``documents`` (id, text) that ``nodes`` (node) names."""
    @lean
    def run(batches):
        for batch in batches:
            for ids, flat, bounds, keys in _sets(batch, k):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_named(ids, keys), pa.int64()), pa.array([x or None for x in keys], pa.binary()),
                     _lists(flat, bounds)], names=["node", "class", "shingles"])

    side = some_ids(nodes)
    id_column = documents.columns[0]
    wanted = documents.join(side, documents[id_column] == side.node, "left_semi")
    rows = wanted.union(documents.filter(documents[id_column].isNull()))
    return rows.mapInArrow(run, "node long, class binary, shingles array<long>").join(side, "node", "left_semi")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets overlap by ``percent`` or more of their union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(left, "a").join(right, "b")
            .filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b"))


def near_duplicates(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
                    words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_shingles, component_id, kept, row_count.

    Texts are compared as sets of distinct ``words``-word shingles of words
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered (fewer words: the whole sequence);
    sets with an overlap of ``percent`` or more of their union are linked.
    ``component_id`` is the smallest id reachable, ``kept`` whether it is the
    row's own, ``row_count`` how many rows share the row's id.

    Null, empty and blank texts have no shingles, link with nothing and are
    kept.  Rows with one id are one document: linked if any of their texts
    is.  A row without an id takes part under a number made from its text,
    larger than any id; its component_id is null if the group has no id.
    An empty table gives no rows; other columns are ignored.
    """
    docs = documents.select(documents[id_column].cast("long").alias("doc_id"),
                            documents[text_column].alias("text"))
    rows = kept(sketches(docs, words), "minhash-rows")
    classes = kept(rows.filter(F.col("class").isNotNull()).groupBy("class")
                   .agg(F.min("node").alias("node"), F.first("n").alias("n"), F.first("keys").alias("keys"),
                        F.first("sketch").alias("sketch")), "minhash-classes")

    keyed = classes.select("node", "n", F.explode("keys").alias("key"))
    heads = (keyed.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last"))
             .filter("head < last").select("key", "head"))
    near = kept(keyed.join(heads, "key"), "minhash-buckets")
    repeated = kept(rows.groupBy("node").agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1"),
                    "minhash-repeated")
    sets = kept(_one_a_text(shingle_table(docs, near.select("node").distinct(), words), repeated), "minhash-sets")
    named = classes.select("class", F.col("node").alias("first_id"))
    # An id with several texts links their classes: its rows are one document.
    same = (rows.filter(F.col("class").isNotNull()).join(repeated, "node", "left_semi")
            .join(named, "class").select(F.col("node").alias("a"), F.col("first_id").alias("b")).distinct())

    low = F.lit(percent / 100 - MARGIN)
    a = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    b = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    first = (near.filter("node != head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
             .join(a, "a").join(b, "b").filter(_sized(percent)).withColumn("like", agreement("ka", "kb", SKETCHED, BITS))
             .filter(F.col("like") >= low).groupBy("b").agg(F.max_by("a", "like").alias("a")))
    links = kept(_confirmed(first, sets, percent).unionByName(same), "minhash-links")

    more = _across(near, components(links), classes, sets, percent, low)
    found = components(links.unionByName(more))

    linked = (rows.select("doc_id", "node", "n", "class").join(named, "class", "left")
              .join(found.withColumnRenamed("node", "first_id"), "first_id", "left")
              .withColumn("component", F.coalesce("component", "first_id", "node")))
    joined = linked.join(repeated, "node", "left").withColumn("row_count", F.coalesce("row_count", F.lit(1)))
    own = F.when(F.col("doc_id").isNull() & F.col("class").isNull(), True).otherwise(
        F.col("node") == F.col("component"))
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("component") < NO_ID, F.col("component")).alias("component_id"),
        own.alias("kept"), "row_count")


def _one_a_text(sets: DataFrame, repeated: DataFrame) -> DataFrame:
    """``sets`` with repeated (node, text) rows once; a shuffle only if any id repeats."""
    if not repeated.limit(1).count():
        return sets.select("node", "shingles")
    twice = sets.join(repeated, "node", "left_semi").dropDuplicates(["node", "class"])
    return sets.join(repeated, "node", "left_anti").union(twice).select("node", "shingles")


def _across(near: DataFrame, found: DataFrame, classes: DataFrame, sets: DataFrame, percent: int,
            low: Column) -> DataFrame:
    """Links (a, b) between bucket members that lie in different components of ``found``.

    Members outside the component of their bucket's head are compared with
    all members.  Small buckets: as pairs, by sketch, then on the full sets.
    Others: in blocks, directly on the full sets, from which only the links
    that join two components come out.
    """
    head = found.select(F.col("node").alias("head"), F.col("component").alias("head_part"))
    parts = (near.join(found, "node", "left").join(head, "head", "left")
             .withColumn("part", F.coalesce("component", "node"))
             .withColumn("head_part", F.coalesce("head_part", "head"))
             .select("key", "node", "n", "part", (F.col("part") != F.col("head_part")).alias("apart")))
    open_keys = (parts.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"),
                                          F.max("apart").alias("open")).filter("open").drop("open"))
    members = kept(parts.join(open_keys, "key"), "minhash-open")

    few = (members.filter(F.col("members") <= PAIRED)
           .join(classes.select("node", "sketch"), "node"))
    left = few.filter("apart").select("key", F.col("node").alias("x"), F.col("n").alias("na"),
                                      F.col("part").alias("px"), F.col("sketch").alias("ka"))
    right = few.select("key", F.col("node").alias("y"), F.col("n").alias("nb"), F.col("part").alias("py"),
                       F.col("sketch").alias("kb"))
    met = left.join(right, (left.key == right.key) & (F.col("px") != F.col("py")) & _sized(percent)
                    & (agreement("ka", "kb", SKETCHED, BITS) >= low))
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    blocks = F.ceil(F.col("total") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    many = (members.filter(F.col("members") > PAIRED).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
            .join(sets, "node").select("key", "low", "high", "own", "node", "part", "apart", "shingles"))
    linked = many.groupBy("key", "low", "high").applyInArrow(
        lambda t: block_links(t, percent), "a long, b long")
    return _confirmed(pairs, sets, percent).unionByName(linked)


def _sized(percent: int) -> Column:
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def block_links(t: pa.Table, percent: int) -> pa.Table:
    """Links of one block pair (or one block with itself) that join two of its components.

    Compares every member that is apart with all members of the other block
    whose size allows, by marking its shingles and counting the marks.
    """
    t = t.combine_chunks()
    node, part, own = (t[c].to_numpy() for c in ("node", "part", "own"))
    apart = t["apart"].to_numpy(zero_copy_only=False)
    sizes = np.diff(t["shingles"].combine_chunks().offsets.to_numpy())
    order = np.argsort(sizes, kind="stable")  # by size: what a size allows is one range
    node, part, own, apart, sizes = (x[order] for x in (node, part, own, apart, sizes))
    flat = t["shingles"].combine_chunks().take(pa.array(order)).values.to_numpy()
    _, flat = np.unique(flat, return_inverse=True)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    marked = np.zeros(int(flat.max(initial=0)) + 1, np.int32)
    names, group = np.unique(part, return_inverse=True)
    parent = list(range(len(names)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    crossing = len(np.unique(own)) > 1
    a, b = [], []
    for x in np.flatnonzero(apart):
        low = int(np.searchsorted(sizes, -(-percent * sizes[x] // 100)))
        high = int(np.searchsorted(sizes, 100 * sizes[x] // percent, side="right"))
        mine = flat[bounds[x]:bounds[x + 1]]
        marked[mine] = 1
        both = np.add.reduceat(marked[flat[bounds[low]:bounds[high]]], bounds[low:high] - bounds[low])
        marked[mine] = 0
        near = 100 * both >= percent * (sizes[x] + sizes[low:high] - both)
        if crossing:
            near &= own[low:high] != own[x]
        for y in np.flatnonzero(near) + low:
            p, q = root(group[x]), root(group[y])
            if p != q:
                parent[p] = q
                a.append(node[x])
                b.append(node[y])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
l AS (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b USING (shingle)
                    WHERE a.doc_id <> b.doc_id GROUP BY ALL) p
  JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id
  WHERE 100 * common >= 80 * (nx.size + ny.size - common)),
r AS (SELECT doc_id, doc_id AS reached FROM documents
      UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.reached = l.x),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.size, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
