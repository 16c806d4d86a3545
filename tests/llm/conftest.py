import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])

SYLLABLES = "an er th on in re ou ti ha ed st nd le or ea".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def make_docs() -> list[tuple]:
    """Nulls in every column, empty, blank and long texts, repeated rows and ids, ties."""
    rng = random.Random(4)
    base = [prose(rng, rng.randint(5, 120)) for _ in range(40)]
    rows = [(k, t, "en", f"src{k % 3}", len(t)) for k, t in enumerate(base)]
    near = base[3].split()
    rows += [(100 + k, " ".join([*near[:-1], f"changed{k}"]), "en", "src0", 5) for k in range(25)]
    rows += [(200 + k, base[5], None, None, None) for k in range(10)]  # exact copies
    rows += [(300, None, "en", "src1", None), (301, "", "en", "src1", 0), (302, " \n\t ", "de", "", 4),
             (303, "one", "en", "src2", 3), (304, "é😀 " * 9 + "\x1c x", "fr", "src2", 30),
             (305, prose(rng, 9000), "en", "src1", 50000), (306, "x" * 30000, "en", "src1", 30000)]
    rows += [(7, base[7], "en", "src1", len(base[7]))] * 3  # repeated rows
    rows += [(8, base[9], "en", "src2", 1)]  # an id with two texts
    rows += [(None, base[11], "en", "src0", 9), (None, base[11], "en", "src0", 9), (None, None, None, None, None),
             (None, prose(rng, 40), "en", "src0", 9)]
    return rows


@pytest.fixture(scope="session")
def doc_rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    """The rows, in several partitions, with extra columns named like ones the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(doc_rows, DOCS).repartition(5)
    names = ("size", "unit", "part", "node", "key", "class", "score", "row", "copies", "target", "kept", "order",
             "previous", "id", "rows", "n", "spans", "label", "quality")
    return df.withColumns({c: F.lit("extra") for c in names})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
