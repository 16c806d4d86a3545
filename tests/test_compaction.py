"""Compaction of published batches."""

import os

import pytest
from pyspark.sql import functions as F

from loadkit.session import local_path
from loadkit.sinks import batches, compaction


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def day_rows(spark, k):
    return spark.range(k * 10, k * 10 + 10).select("id", F.when(F.col("id") % 4 > 0, F.col("id")).alias("v"),
                                                   F.lit("2024-01-01").cast("date").alias("d"))


def files(path, folders):
    return [f for x in folders for _, _, names in os.walk(local_path(f"{path}/{x}")) for f in names
            if f.endswith(".parquet")]


@pytest.mark.parametrize("parts", [None, ["d"]])
def test_fifty_appends_to_one_day_become_few_files(spark, tmp_shared, parts):
    schema = day_rows(spark, 0).schema
    for k in range(50):
        batches.append_batch(day_rows(spark, k % 49), tmp_shared, f"b{k}", partition_by=parts)  # one comes twice
    before = batches.read_batches(spark, tmp_shared, schema)
    was = rows(before)
    assert len(files(tmp_shared, batches.live_folders(spark, tmp_shared))) >= 50
    done = compaction.compact(spark, tmp_shared, schema, partition_by=parts)
    assert len(done) == 1 and done[0]["swapped"] and len(done[0]["replaces"]) == 50
    live = batches.live_folders(spark, tmp_shared)
    assert len(live) == 1 and len(files(tmp_shared, live)) == 1
    assert rows(batches.read_batches(spark, tmp_shared, schema)) == was and len(was) == 500
    assert rows(before) == was  # a reader of the old files is undisturbed
    assert not batches.append_batch(day_rows(spark, 3), tmp_shared, "b3")  # a batch is still known by its id
    assert compaction.compact(spark, tmp_shared, schema, partition_by=parts) == []


def test_of_two_compactions_at_once_one_counts(spark, tmp_shared, monkeypatch):
    schema = day_rows(spark, 0).schema
    for k in range(5):
        batches.append_batch(day_rows(spark, k), tmp_shared, f"b{k}")
    was = rows(batches.read_batches(spark, tmp_shared, schema))
    real = compaction.write_batch

    def slow(df, path, **kw):
        folder = real(df, path, **kw)
        with monkeypatch.context() as m:
            m.setattr(compaction, "write_batch", real)
            assert compaction.compact(spark, path, schema)[0]["swapped"]
        return folder

    monkeypatch.setattr(compaction, "write_batch", slow)
    assert [c["swapped"] for c in compaction.compact(spark, tmp_shared, schema)] == [False]
    assert rows(batches.read_batches(spark, tmp_shared, schema)) == was


def test_a_batch_published_meanwhile_and_another_compaction_stay(spark, tmp_shared):
    schema = day_rows(spark, 0).schema
    for k in range(4):
        batches.append_batch(day_rows(spark, k), tmp_shared, f"a{k}")
    first = batches.live_folders(spark, tmp_shared)
    batches.append_batch(day_rows(spark, 9), tmp_shared, "late")
    for pair in (first[:2], first[2:]):  # two swaps that share no folder both count
        folder = batches.write_batch(batches.read_folders(spark, tmp_shared, pair, schema), tmp_shared)
        assert compaction.swap(spark, tmp_shared, folder, pair)
    assert len(batches.live_folders(spark, tmp_shared)) == 3
    assert [r[0] for r in rows(batches.read_batches(spark, tmp_shared, schema).select("id").orderBy("id"))] == sorted(
        [*range(40), *range(90, 100)], key=lambda x: str((x,)))


def test_groups_are_of_like_size():
    sizes = {"a": 10, "b": 12, "c": 39, "d": 500, "e": 600, "f": 700, "g": 1900, "h": 90_000}
    assert compaction.like_sized(sizes, 4, 4) == ["d", "e", "f", "g"]
    assert compaction.like_sized(sizes, 3, 4) == ["a", "b", "c"]
    assert compaction.like_sized(sizes, 5, 4) == [] and compaction.like_sized({}, 2, 4) == []
    assert compaction.like_sized({"a": 0, "b": 0}, 2, 4) == ["a", "b"]


def test_empty_tables_and_wrong_parameters(spark, tmp_shared):
    schema = day_rows(spark, 0).schema
    assert compaction.compact(spark, tmp_shared, schema) == []
    with pytest.raises(ValueError):
        compaction.compact(spark, tmp_shared, schema, min_folders=1)
