import re
from collections import Counter

from pyspark.sql import functions as F

from loadkit.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """Shares by weight, limited to 3 times the size, the excess shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, free, out = sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in full:
            out[s] = 3 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def test_targets_and_bounds(docs, doc_rows):
    size = Counter()
    for _, text, _, source, _ in doc_rows:
        size[source] += len(WORD.findall(text or ""))
    want = targets(size)
    rows = mixing.mix_sizes(docs).join(
        docs.select(F.col("doc_id").alias("d"), F.col("source").alias("s")).distinct(),
        F.col("doc_id").eqNullSafe(F.col("d")))
    assert mixing.mix_sizes(docs).count() == len(doc_rows)
    for r in rows.filter("doc_id is not null and doc_id not in (8)").collect():
        assert r.source_size == size[r.s] and abs(r.target - want[r.s]) < 1e-6 * max(want[r.s], 1)
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)


def test_taken_is_near_the_target(spark):
    """Off by half a document at most, with repeated rows and a hot source."""
    rows = [(k, "w " * (k % 37 + 1), "hot" if k % 3 else f"s{k % 5}") for k in range(3000)] + [(5, "w w", "hot")] * 700
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sizes(df, group=16).groupBy("target", "source_size").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 37 for r in got)
    again = mixing.mix_sizes(df.repartition(7), group=16).orderBy("doc_id", "taken").collect()
    assert again == mixing.mix_sizes(df, group=16).orderBy("doc_id", "taken").collect()


def test_rounding_keeps_expectations(spark):
    """Over many hash seeds (here: id ranges) each document is taken about as often as wanted."""
    rows = [(k, "w " * 10, ("a", "b", "c")[k % 3]) for k in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sizes(df).groupBy("target", "source_size").agg(F.avg("copies").alias("mean")).collect()
    for r in got:
        assert abs(r.mean - r.target / r.source_size) < 0.01


def test_mix_repeats_rows(docs, doc_rows):
    counts = {(r.doc_id, r.size): 0 for r in mixing.mix_sizes(docs).collect()}
    for r in mixing.mix_sizes(docs).collect():
        counts[r.doc_id, r.size] += r.copies
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in mixed.collect())
    assert sum(got.values()) == sum(counts.values()) or abs(sum(got.values()) - sum(counts.values())) <= 6


def test_empty_and_wordless(spark, no_docs):
    assert mixing.mix_sizes(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.size, r.taken, r.target) for r in mixing.mix_sizes(blank).collect()] == [(0, 0, 0.0)] * 2
