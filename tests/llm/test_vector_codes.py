"""Vector codes against Lloyd rounds written out."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadkit.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label string"


def brute(rows: list[tuple], rounds: int = 2) -> list[tuple]:
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(-(-max(len(v) for _, v, _ in kept) // 16), 1)
    parts = [[(v + [0] * (16 * width))[p * width:(p + 1) * width] for p in range(16)] for _, v, _ in kept]
    start = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:64]
    books = [[parts[k][p] for k in start] for p in range(16)]

    def best(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(16):
            members = defaultdict(list)
            for v in parts:
                members[best(v[p], books[p])[1]].append(v[p])
            for k, own in members.items():
                books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [[best(v[p], books[p]) for p in range(16)] for v in parts]
    errors = defaultdict(int)
    for (_, _, label), c in zip(kept, coded, strict=True):
        errors[label] += sum(d for d, _ in c)
    return sorted(((i, "".join(f"{k:02x}" for _, k in c), sum(d for d, _ in c), errors[label], digest)
                   for (i, _, label), c in zip(kept, coded, strict=True)), key=repr)


def vectors(seed: int, n: int, size: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(k, [rng.choice([-0.5, 0.0, 0.25, rng.gauss(0, 0.1)]) for _ in range(size)], rng.choice(["x", "y", None]))
            for k in range(n)]
    rows += rows[:5] + [(3, rows[7][1], "x"), (None, rows[9][1], "z"), (None, rows[9][1], None)]
    same = [rng.gauss(0, 0.1) for _ in range(size)]
    rows += [(1000 + k, same, "hot") for k in range(n // 2)]  # a third of all rows in one entry
    rows += [(-5, None, "x"), (-4, [None] * size, "x"), (-3, [float("nan")] * size, "y"),
             (-2, [*same[:-1], float("inf")], "y"), (-1, [*same[:-1], float("-inf")], None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size,n", [(32, 300), (16, 40), (20, 90)])
def test_codes_as_by_brute_force(spark, monkeypatch, size, n):
    monkeypatch.setattr(vector_codes, "MEMBERS", 64)  # several salts
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l)
            for i, v, l in vectors(size, n, size)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns(
        {c: F.lit("extra") for c in ("pos", "entry", "salt", "whole", "code", "of", "moved")})
    got = sorted((tuple(r) for r in vector_codes.compress_vectors(table).collect()), key=repr)
    assert got == brute(rows)


def test_only_members_that_change_move(spark):
    rows = [([[0.0] * 16, [1.0] * 16][k % 2],) for k in range(40)]
    whole = spark.createDataFrame([([int(256 * x) for x in v], 0) for v, in rows], "whole array<int>, salt int")
    books = np.stack([np.array([[0], [100], [256]])] * 16)
    owners = vector_codes.arrived(vector_codes.first_owners(whole, books, 1), "owners-test")
    assert owners.filter("not moved").count() == 0
    books = vector_codes.next_books(owners, books)
    assert books[:, :, 0].tolist() == [[0, 100, 256]] * 16  # the unused entry stays
    again = vector_codes.reassigned(owners, books)
    assert again.filter("moved").count() == 0
    books[:, 1] = 255
    books[:, 2] = 9999
    moved = vector_codes.reassigned(owners, books).groupBy("entry", "moved").agg(F.sum(F.length("members")).alias("b"))
    assert {(r.entry, r.moved): r.b for r in moved.collect()} == {(0, False): 16 * 20 * 4, (1, True): 16 * 20 * 4}


def test_uneven_and_huge_vectors(spark):
    rows = [(1, [1.0], "a"), (2, [0.5] * 17, "a"), (3, [], None), (4, [1e30, -1e30], "b")]
    got = {r.vec_id: r for r in vector_codes.compress_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {1, 2, 3, 4} and all(len(r.code) == 32 and r.error == 0 for r in got.values())


def test_no_usable_rows(spark):
    for rows in ([], [(1, None, "a"), (2, [None], "a"), (None, [float("nan")], None)]):
        out = vector_codes.compress_vectors(spark.createDataFrame(rows, SCHEMA))
        assert out.collect() == []
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
