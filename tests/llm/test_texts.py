"""Fingerprints, quality rules and the classifiers."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loadkit.llm import fingerprints as fp
from loadkit.llm import llr_rules, textbatch
from loadkit.llm.fm_quality import Machine, chance, fit_machine, quality_scores, raw_scores
from loadkit.llm.toxicity import PATTERNS, subsequences, table_scores, toxicity_scores, unit_symbols, units
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_and_hashes(doc_rows):
    texts = [r[1] for r in doc_rows]
    column = pa.chunked_array([pa.array(texts[:20]), pa.array(texts[20:]).slice(0)])
    seen, rows = {}, 0
    for s in textbatch.slices(column, chunk=500):
        w = textbatch.words(s)
        for d in range(s.n):
            own = [x.encode() for x in WORD.findall(texts[s.first + d] or "")]
            a, b = w.bounds[d], w.bounds[d + 1]
            assert [bytes(s.data[p:q]) for p, q in zip(w.starts[a:b], w.ends[a:b], strict=True)] == own
            for h, x in zip(w.hashes[a:b].tolist(), own, strict=True):
                assert seen.setdefault(h, x) == x
        rows += s.n
    assert rows == len(texts) and len(set(seen.values())) == len(seen)


def test_edited_report(docs, doc_rows):
    rows = defaultdict(list)
    for r in doc_rows:
        rows[r[0]].append(r[1] or "")
    order = sorted(rows, key=lambda k: (k is not None, k))
    got = fp.edited_report(docs).collect()
    assert len(got) == len(doc_rows)
    prints = {}
    for r in got:
        after = rows[order[(order.index(r.doc_id) + 1) % len(order)]]
        choices = {}
        for text in rows[r.doc_id]:
            if len(text) != r.n_chars:
                continue
            q = len(text) // 4
            for follower in after:
                edited = text[:len(text) - q] + follower[:q]
                choices[hashlib.sha256(edited.encode()).hexdigest()] = (text, edited)
        text, edited = choices[r.edited_sha256]
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if text == edited:
            assert r.near_edited == 1


def test_fingerprint_likeness_is_unbiased():
    rng = np.random.default_rng(1)
    errors = []
    for size in (20, 200, 2000):
        for share in (0.2, 0.5, 0.8, 0.95):
            for _ in range(20):
                both = int(size * share)
                pool = np.unique(rng.integers(0, 2 ** 63, 2 * size, dtype=np.uint64) * np.uint64(2))
                rng.shuffle(pool)
                a = np.sort(pool[:size])
                b = np.sort(np.concatenate([pool[:both], pool[size:2 * size - both]]))
                x, y = (fp.signatures(s, np.array([0, len(s)]))[0] for s in (a, b))
                groups = [[(int(v) >> (4 * k)) & 15 for v in z for k in range(16)] for z in (x, y)]
                same = np.mean([p == q for p, q in zip(*groups, strict=True)])
                errors.append((same - 1 / 16) / (15 / 16) - both / (2 * size - both))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.12


def test_fingerprints_keep_columns(docs, doc_rows):
    out = fp.fingerprints(docs)
    assert out.columns == [*docs.columns, "fingerprint"] and out.count() == len(doc_rows)


def brute_rules(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for j in range(len(w) - 7):
        at[tuple(w[j:j + 8])].append(j)
    covered = {k for own in at.values() if len(own) > 1 for j in own for k in range(j, j + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def test_rules_match_brute_force(spark, docs, doc_rows):
    rng = random.Random(9)
    block = prose(rng, 12)
    more = [(900, f"{block}\n{block}\n\n{block} | # é\n", None, None, 1), (901, "a b\na b\n" * 30, None, None, 1),
            (902, "\n\n\n", None, None, 1), (903, "x\nx\nx", None, None, 1)]
    rows = [*doc_rows, *more]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    trusted = spark.createDataFrame([(k,) for k in range(30)] + [(None,), (3,)], "doc_id long")
    got = sorted((str(r.doc_id), *tuple(r)[1:6]) for r in llr_rules.quality_rules(df, trusted).collect())
    assert got == sorted((str(r[0]), *brute_rules(r[1])) for r in rows)


def test_log_ratio_counts_everything(spark, docs, doc_rows):
    trusted = spark.createDataFrame([(k,) for k in range(30)], "doc_id long")
    totals = llr_rules.bucket_counts(docs, trusted, "doc_id", "text")
    sizes = [(r[0], len(WORD.findall(r[1] or ""))) for r in doc_rows]
    grams = [(d, n + max(n - 1, 0)) for d, n in sizes]
    assert totals[0].sum() == sum(n for _, n in grams)
    assert totals[1].sum() == sum(n for d, n in grams if d is not None and d < 30)


def test_rules_drop_foreign_text(spark):
    rng = random.Random(2)
    rows = [(k, prose(rng, 60)) for k in range(60)]
    rows += [(100 + k, " | ".join(f"{c}{c}" for c in rng.choices("abcdefgh", k=60))) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in llr_rules.quality_rules(df, df.filter("doc_id < 40").select("doc_id")).collect()}
    assert all(got[k].kept for k in range(60)) and not any(got[100 + k].kept for k in range(20))


def test_machine_score_is_all_pairs():
    """The sum-of-squares identity against the double sum over feature pairs."""
    rng = np.random.default_rng(0)
    words = [(np.sort(rng.choice(16384, 12, replace=False)), rng.random(12)) for _ in range(40)]
    stats = rng.random((40, 3))
    m = fit_machine((rng.random(40) > 0.5).astype(float), np.ones(40), words, stats)
    m = Machine.load(m.dump())
    feature = np.concatenate([w[0] for w in words])
    value = np.concatenate([w[1] for w in words]).astype(np.float32)
    score, _ = raw_scores(m, np.arange(40) * 12, feature, value)
    for r in range(40):
        f, x = words[r]
        v = m.vectors[f].astype(float)
        pairs = sum(v[i] @ v[j] * x[i] * x[j] for i in range(12) for j in range(i))
        assert abs(m.bias[0] + m.weights[f] @ x + pairs - score[r]) < 1e-4
    assert ((chance(score) > 0) & (chance(score) < 1)).all()


def labelled(spark, n, bad):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(n):
        toxic = k % 3 == 0
        words = prose(rng, rng.randint(30, 80)).split()
        if toxic:
            words.insert(rng.randrange(len(words)), bad(rng))
        rows.append((k, " ".join(words), len(words)))
        labels.append((k, int(toxic), None if k % 50 == 1 else int(toxic)))
    extra = [(None, None, None), (None, "word", 4), (n + 1, "", 0), (n + 2, " \n", 2), (n + 3, "z" * 40000, 40000),
             (0, rows[0][1], None)]
    return (spark.createDataFrame(rows + extra, "doc_id long, text string, n_chars long").repartition(4),
            spark.createDataFrame([*labels, (None, 1, 1), (0, 0, 0)], "doc_id long, toxic int, quality int"), n + 6)


def test_toxicity_finds_insults(spark):
    insults = ["blorgface", "quazzit", "frumpkin"]

    def bad(rng):
        word = rng.choice(insults)
        if rng.random() < 0.3:
            at = rng.randrange(2, len(word) - 2)
            word = word[:at] + rng.choice("*.-") + word[at:]
        return word

    df, labels, total = labelled(spark, 600, bad)
    got = toxicity_scores(df, labels).collect()
    assert len(got) == total and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id and r.doc_id < 600]
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in held]) > 0.95
    assert all(not r.predicted for r in got if r.doc_id is None or r.doc_id > 600)


def test_spaced_insult_is_one_unit():
    for s in textbatch.slices(pa.array(["you i d i o t now"])):
        w = textbatch.words(s, lower=True)
        _, first, end, _ = units(s, w)
        assert (end - first).tolist() == [1, 5, 1]
        code, bounds = unit_symbols(s, w, first, end)
        assert code[bounds[1]:bounds[2]].tolist() == [30, 9, 4, 9, 15, 20, 31]
        assert len(table_scores(code, bounds, np.ones(1 << 20, np.float32))) == 3


def coded(texts):
    """(symbols, bounds) of the texts' units."""
    (s,) = textbatch.slices(pa.array(texts))
    w = textbatch.words(s, lower=True)
    _, first, end, _ = units(s, w)
    return unit_symbols(s, w, first, end)


def test_six_symbols_count_with_two_letters_put_in_or_left_out():
    """Six of moron's symbols, its start among them, are still counted in moxryon; so are those of a longer word."""
    def sixes(word):
        return {int(n) for p in PATTERNS if len(p) == 6
                for number, ok, _ in subsequences(*coded([word]), [p]) for n in number[ok]}

    assert sixes("moron") & sixes("moxryon") and sixes("moron") & sixes("moxron")
    assert sixes("frumpkin") & sixes("fruxmpykin") and sixes("frumpkin") & sixes("frumkn")


def test_insult_glued_into_long_units_is_found(spark):
    insults = ["blorgface", "quazzit", "frumpkin"]
    df, labels, _ = labelled(spark, 300, lambda rng: rng.choice(insults))
    rng = random.Random(12)
    rows, names = [], []
    for n in (50, 1000):
        for mark in ("", "_"):
            for toxic in (0, 1):
                for _ in range(40):
                    words, insult = prose(rng, n).split(), rng.choice(insults)
                    at = rng.randrange(n // 4)
                    glued = mark.join([*words[:at], *[insult] * toxic, *words[at:]])
                    start = max(0, glued.index(insult) - n // 2) if toxic else 0
                    rows.append((1000 + len(rows), glued[start:start + n], n))
                    names.append((n, mark, toxic))
    more = df.union(spark.createDataFrame(rows, df.schema))
    found = dict.fromkeys(names, 0)
    for r in toxicity_scores(more, labels).filter("doc_id >= 1000").collect():
        found[names[r.doc_id - 1000]] += r.predicted
    for (_, mark, toxic), hits in found.items():
        assert hits >= (38 if mark else 20) if toxic else hits <= 2


def test_quality_learns_structure(spark):
    def bad(rng):
        return " ".join("|" + w for w in prose(rng, 40).split())

    df, labels, total = labelled(spark, 600, bad)
    got = quality_scores(df, labels).collect()
    assert len(got) == total and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id and r.doc_id < 600]
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in held]) > 0.9


@pytest.mark.parametrize("score", [quality_scores, toxicity_scores])
def test_classifiers_without_rows_or_labels(spark, docs, no_docs, doc_rows, score):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert score(no_docs, labels).count() == 0
    got = score(docs, labels).collect()  # one class only
    assert len(got) == len(doc_rows) and len({r.score for r in got}) == 1


def test_rules_and_report_of_nothing(spark, no_docs):
    trusted = spark.createDataFrame([], "doc_id long")
    assert llr_rules.quality_rules(no_docs, trusted).count() == 0
    assert fp.edited_report(no_docs).count() == 0


def test_sample_is_bounded_when_an_id_repeats(spark):
    from pyspark.sql import functions as F

    from loadkit.llm.learning import labelled_sample

    df = spark.createDataFrame([(k % 5, f"t{k}", k) for k in range(400)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, quality int")
    got = labelled_sample(df, labels, "quality", [F.col("text")], per_class=10)
    assert got.columns == ["__order", "__label", "__weight", "text"]
    assert got.count() == got.select("__order").distinct().count() <= 5
