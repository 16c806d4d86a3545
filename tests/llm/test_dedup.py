import re
import string

import pytest
from pyspark.sql import functions as F

from loadkit.llm import minhash_dedup as M
from loadkit.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, k):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else (
        frozenset([tuple(w)]) if w else frozenset())


def brute(rows, k):
    """Component (smallest id) of each row by comparing all pairs; rows without an id by number -1 - index."""
    sets = [(r[0], shingles(r[1], k)) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (a, s) in enumerate(sets):
        for j, (b, t) in enumerate(sets[:i]):
            both = len(s & t)
            if (a is not None and a == b) or (s and t and 100 * both >= 80 * (len(s) + len(t) - both)):
                parent[root(i)] = root(j)
    groups = {}
    for i, (a, _) in enumerate(sets):
        groups.setdefault(root(i), []).append(a)
    return [min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(rows))], sets


@pytest.mark.parametrize("paired", [0, 16])
@pytest.mark.parametrize("words", [4, 5])
def test_components_match_brute_force(docs, doc_rows, monkeypatch, words, paired):
    monkeypatch.setattr(M, "PAIRED", paired)
    monkeypatch.setattr(M, "BLOCK", 400)  # several blocks a bucket
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in M.near_duplicates(docs, words=words).collect()),
                 key=str)
    parts, sets = brute(doc_rows, words)
    assert got == sorted(((a, len(s), c) for (a, s), c in zip(sets, parts, strict=True)), key=str)


def test_one_of_each_group_is_kept(docs):
    rows = M.near_duplicates(docs).collect()
    for r in rows:
        if r.doc_id is not None:
            assert r.kept == (r.doc_id == r.component_id)
    assert {r.row_count for r in rows if r.doc_id == 7} == {4}


def test_empty_table(no_docs):
    assert M.near_duplicates(no_docs).count() == 0


def test_chain_is_one_component(spark):
    """a-b and b-c are near, a-c are not; the middle one has the largest id."""
    words = [f"w{k}" for k in range(120)]
    a, b, c = (" ".join(words[s:s + 100]) for s in (0, 8, 16))
    df = spark.createDataFrame([(1, a), (2, c), (9, b)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in M.near_duplicates(df, words=4).collect()}
    assert got == {1: 1, 2: 1, 9: 1}


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components(edges.union(spark.createDataFrame([(900, 901)], "a long, b long")))
            .collect()} == {0, 900}


def test_sketch_estimate_is_close(spark):
    """The corrected share of equal low bits estimates the overlap of two sets."""
    words = [f"v{k}" for k in range(900)]
    for cut in (0, 60, 200, 500):
        df = spark.createDataFrame([(1, " ".join(words[:700])), (2, " ".join(words[cut:cut + 700]))],
                                   "doc_id long, text string")
        s, t = shingles(" ".join(words[:700]), 5), shingles(" ".join(words[cut:cut + 700]), 5)
        rows = M.sketches(df, 5).select("doc_id", "sketch")
        a = rows.filter("doc_id = 1").select(F.col("sketch").alias("x"))
        b = rows.filter("doc_id = 2").select(F.col("sketch").alias("y"))
        like = a.join(b, F.lit(True)).select(M.agreement("x", "y", M.SKETCHED, M.BITS)).first()[0]
        assert abs(like - len(s & t) / len(s | t)) < 0.12
