import random

import corpus_pipeline
import pytest

from loadkit.llm.catalog import QUERIES
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipe") / name)
        stage(spark, out[-1], SF_SMALL).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_and_effect(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in steps]
    assert ids[1] <= ids[0] and ids[2] <= ids[1] and ids[3] == ids[2] and ids[4] <= ids[3] and ids[5] == ids[4]


def test_no_near_duplicates_left(steps):
    from loadkit.llm.minhash_dedup import near_duplicates

    assert near_duplicates(steps[2]).filter("not kept").count() == 0


def test_run_is_the_stages(spark, steps):
    last = corpus_pipeline.run(spark, SF_SMALL).select("doc_id", "start", "length", "ids_crc32")
    assert sorted(last.collect()) == sorted(steps[-1].select(*last.columns).collect())


def test_odd_documents_pass(spark, docs, doc_rows):
    """Nulls, blanks, repeats: each stage survives them; clean rows without words stay until mixing."""
    got = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[1:3]:
        got = stage(spark, got, SF_SMALL)
    ids = [r.doc_id for r in got.collect()]
    assert ids.count(7) == 1 and {300, 301, 302} <= set(ids) and not {201, 209} & set(ids)


def test_different_texts_under_one_id_stay(spark):
    from tests.llm.conftest import DOCS, prose

    rng = random.Random(12)
    a, b, c = (prose(rng, 60) for _ in range(3))
    near = " ".join([*a.split()[:-1], "other"])
    rows = [(1, a), (1, b), (2, near), (2, near), (None, None), (None, None), (None, " "), (None, " "), (None, c),
            (None, c), (3, None), (3, ""), (4, "\n"), (4, "\n")]
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, table, SF_SMALL).collect()), key=repr)
    blank = [r for r in rows if not (r[1] or "").strip()]
    assert [r for r in got if not (r[1] or "").strip()] == sorted(blank, key=repr)
    worded = [r for r in got if (r[1] or "").strip()]
    assert len(worded) == 3 and {t for _, t in worded} - {a, near} == {b, c}


WORDLESS = [(1, None), (2, ""), (3, " \n\t"), (None, None), (None, ""), (4, " "), (4, " ")]


@pytest.fixture(scope="module")
def wordless_dir(spark, tmp_path_factory):
    """Tables whose documents have no word; the others as given."""
    from tests.llm.conftest import DOCS

    path = str(tmp_path_factory.mktemp("wordless"))
    (spark.createDataFrame([(i, t, None, "s", None) for i, t in WORDLESS], DOCS).coalesce(2)
     .write.parquet(f"{path}/documents.parquet"))
    for name in ("labels", "conversations", "embeddings"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op9_chat_events", "op13_resident_lloyd"}))
def test_tables_without_a_word(spark, wordless_dir, name):
    got = [r.doc_id for r in QUERIES[name](spark, wordless_dir).collect() if "doc_id" in r]
    if name not in ("op2_bfd_packing", "op10_tier_packing"):
        assert sorted(got, key=repr) == sorted((i for i, _ in WORDLESS), key=repr)


def test_stages_without_a_word(spark, wordless_dir):
    got = spark.read.parquet(f"{wordless_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, got, wordless_dir)
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(WORDLESS, key=repr)
    for _, stage in corpus_pipeline.STAGES[3:]:
        got = stage(spark, got, wordless_dir)
    got.collect()


def test_empty_documents(spark, no_docs):
    got = no_docs
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, got, SF_SMALL)
    assert got.count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0
