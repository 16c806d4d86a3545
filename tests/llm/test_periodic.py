"""Periodic runs against a scan of every period."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from loadkit.llm import periodic
from tests.llm.conftest import DOCS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def sequences(rng: random.Random) -> list[list[int]]:
    out = []
    for _ in range(rng.randint(1, 9)):
        n, letters = rng.choice([0, 1, 5, 6, 7, 30, 120, 300]), rng.choice([1, 2, 3, 5, 20])
        words = [rng.randrange(letters) for _ in range(n)]
        if n > 20 and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(3, 9)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        out.append(words)
    return out


@pytest.mark.parametrize("places", [periodic.PLACES, 5])
def test_runs_as_by_brute_force(monkeypatch, places):
    monkeypatch.setattr(periodic, "PLACES", places)
    monkeypatch.setattr(periodic, "ROWS", 50)
    rng = random.Random(3)
    for _ in range(120):
        docs = sequences(rng)
        seq, starts, ends, sizes = periodic.sequence([np.array(d, np.int64) for d in docs])
        runs = periodic.runs_of(seq, ends, sizes)
        for d, words in enumerate(docs):
            own = (runs.start >= starts[d]) & (runs.start < starts[d] + len(words))
            assert list(zip((runs.start[own] - starts[d]).tolist(), runs.length[own].tolist(),
                            runs.period[own].tolist(), strict=True)) == brute_runs(words)


def test_extensions_reach_as_far_as_the_words_agree():
    rng = random.Random(8)
    seq = np.array([rng.randrange(1, 3) for _ in range(60)] * 6 + [9], np.int32)
    found = periodic.Extensions(seq)
    i = np.array([rng.randrange(300) for _ in range(3000)])
    j = i + 1 + np.array([rng.randrange(60) for _ in range(3000)])
    for a, b, n in zip(i.tolist(), j.tolist(), found.of(i, j).tolist(), strict=True):
        k = 0
        while b + k < len(seq) and seq[a + k] == seq[b + k]:
            k += 1
        assert n == k


def report(doc_id, text) -> tuple:
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    top = (None,) * 4
    if runs:
        a, m, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        top = (a, m, q, 1000 * m // q)
    gone = {k for a, m, q in runs for k in range(a + q, a + m)}
    left = " ".join(w for k, w in enumerate(words) if k not in gone)
    lines = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(left.encode()).hexdigest())


def texts() -> list[tuple]:
    rng = random.Random(6)
    rows = []
    for k in range(150):
        words = [rng.choice(["a", "bé", "c,", "漢"][:rng.randint(1, 4)]) for _ in range(rng.choice([0, 3, 8, 90, 400]))]
        rows.append((k, rng.choice([" ", "\n", "\t \x0b"]).join(words), "en", "s", 1))
    return rows


def test_report(spark, docs, doc_rows):
    short = [r for r in doc_rows if len(r[1] or "") < 20_000]
    for table, rows in ((docs.filter("text is null or length(text) < 20000"), short),
                        (spark.createDataFrame(texts(), DOCS).repartition(3), texts())):
        got = Counter(tuple(r) for r in periodic.run_report(table).collect())
        assert got == Counter(report(r[0], r[1]) for r in rows)


def test_runs_and_collapsed_texts(spark):
    rows = texts()
    table = spark.createDataFrame([*rows, (900, None, None, None, None)], DOCS)
    found = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.periodic_runs(table).collect()}
    left = {r.doc_id: r.text for r in periodic.collapse_runs(table).collect()}
    for doc_id, text, *_ in rows:
        words = WORD.findall(text)
        assert found[doc_id] == brute_runs(words)
        gone = {k for a, m, q in found[doc_id] for k in range(a + q, a + m)}
        assert left[doc_id] == " ".join(w for k, w in enumerate(words) if k not in gone)
    assert found[900] == [] and left[900] is None


def test_wordless_and_empty_tables(spark, no_docs):
    blank = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, 0), (3, " \n", None, None, 2)], DOCS)
    assert {r.n_runs for r in periodic.run_report(blank).collect()} == {0}
    assert periodic.run_report(no_docs).collect() == []
    assert periodic.periodic_runs(no_docs).collect() == [] and periodic.collapse_runs(no_docs).collect() == []
