"""Ledgers, published batches, key ranges and bucketed dimensions."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from loadkit.operators.scd import scd1_merge, scd2_merge
from loadkit.plans import loads
from loadkit.plans.audit import AuditTrail
from loadkit.session import local_path
from loadkit.sinks import batches, buckets, ledger
from loadkit.sinks import tables as sinks
from loadkit.streaming.ingest import ingest_new_files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_an_entry_is_created_once(spark, tmp_shared):
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: ledger.create_entry(spark, f"{tmp_shared}/_e/x", {"k": k}), range(24)))
    assert sum(won) == 1
    assert ledger.read_entry(spark, f"{tmp_shared}/_e/x") == {"k": won.index(True)}
    assert ledger.entry_names(spark, f"{tmp_shared}/_e") == ["x"]
    assert ledger.read_entry(spark, f"{tmp_shared}/_e/y") is None and ledger.entry_names(spark, f"{tmp_shared}/_f") == []


def test_entries_by_the_file_systems_rename(spark, tmp_shared, monkeypatch):
    monkeypatch.setattr(ledger, "_is_local", lambda *_: False)
    assert ledger.create_entry(spark, f"{tmp_shared}/_e/x", {"k": 1})
    assert not ledger.create_entry(spark, f"{tmp_shared}/_e/x", {"k": 2})
    assert ledger.read_entry(spark, f"{tmp_shared}/_e/x") == {"k": 1}
    assert ledger.entry_names(spark, f"{tmp_shared}/_e") == ["x"]
    assert [ledger.take_number(spark, f"{tmp_shared}/_n", k) for k in "abab"] == [0, 1, 0, 1]


def test_ranges_of_many_threads_follow_each_other(spark, tmp_shared):
    def reserve(k):
        return ledger.reserve_range(spark, f"{tmp_shared}/_r", f"run-{k}", k + 1, 100), k + 1

    with ThreadPoolExecutor(8) as pool:
        got = sorted(pool.map(reserve, range(20)))
    at = 100
    for start, count in got:
        assert start == at
        at += count
    assert ledger.reserve_range(spark, f"{tmp_shared}/_r", "run-3", 4, 0) in [s for s, n in got if n == 4]


def test_keys_go_on_from_earlier_state(spark, tmp_shared):
    spark.createDataFrame([("old", 41)], loads._KEY_SCHEMA).write.parquet(f"{tmp_shared}/{loads.KEY_STATE}")
    assert loads.reserve_keys(spark, tmp_shared, "a", "sk", 5) == 41
    assert loads.reserve_keys(spark, tmp_shared, "b", "sk", 2) == 46
    assert loads.reserve_keys(spark, tmp_shared, "a", "sk", 5) == 41


def test_keys_of_a_folder_without_rows(spark, tmp_shared):
    ledger.create_entry(spark, f"{tmp_shared}/t/_other/x", {})  # what a load that runs at once may have made
    assert loads._last_key(spark, f"{tmp_shared}/t", "sk") == 0
    spark.range(3).write.parquet(f"{tmp_shared}/u")
    with pytest.raises(Exception, match="sk"):
        loads._last_key(spark, f"{tmp_shared}/u", "sk")


def test_a_batch_lands_once(spark, tmp_shared):
    df = spark.range(10).withColumn("d", F.col("id") % 3)
    batches.write_batch(df, tmp_shared, partition_by=["d"])  # died before its entry
    assert rows(batches.read_batches(spark, tmp_shared, df.schema)) == []
    assert batches.append_batch(df, tmp_shared, "one", partition_by=["d"])
    assert not batches.append_batch(df, tmp_shared, "one", partition_by=["d"])
    batches.append_batch(df.withColumn("id", F.col("id") + 100), tmp_shared, "two / ü", partition_by=["d"])
    back = batches.read_batches(spark, tmp_shared, df.schema)
    assert back.columns == df.columns and back.count() == 20 and rows(back.filter("id < 100")) == rows(df)


@pytest.mark.parametrize("kind", ["generic", "flat"])
def test_a_killed_load_runs_again(spark, tmp_shared, monkeypatch, kind):
    source = spark.range(30).select(F.col("id").cast("string").alias("a"))
    source.coalesce(2).write.csv(f"{tmp_shared}/in")

    def run():
        audit = AuditTrail(kind, batch_id="b1")
        if kind == "generic":
            return loads.load_generic(spark, source, path=f"{tmp_shared}/t", once=True, audit=audit)
        return loads.load_flat_file(spark, f"{tmp_shared}/in", ["a"], path=f"{tmp_shared}/t", header=False,
                                    conversions={"a": "bigint"}, once=True, audit=audit)

    def die(*_, **__):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(batches, "publish_batch", die)
        with pytest.raises(RuntimeError, match="killed"):
            run()
    for _ in range(2):
        out = run().output
        assert out.count() == 30 and out.select("a").distinct().count() == 30


def drop(spark, folder, ids):
    spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.option("header", "true").csv(folder)


def ingest(spark, root, name, checkpoint):
    from pyspark.sql import types as T

    return ingest_new_files(spark, f"{root}/{name}/*/*.csv", T.StructType([T.StructField("id", T.LongType())]),
                            target=f"{root}/target", checkpoint=f"{root}/{checkpoint}", options={"header": "true"})


def test_sources_and_renewed_checkpoints_keep_all_rows(spark, tmp_shared):
    drop(spark, f"{tmp_shared}/a/1", [1, 2])
    drop(spark, f"{tmp_shared}/b/1", [3])
    assert ingest(spark, tmp_shared, "a", "ca")["written"] == 2
    assert ingest(spark, tmp_shared, "b", "cb")["written"] == 1
    drop(spark, f"{tmp_shared}/a/2", [4])
    assert ingest(spark, tmp_shared, "a", "ca")["written"] == 1
    assert rows(spark.read.parquet(f"{tmp_shared}/target").select("id")) == [(1,), (2,), (3,), (4,)]
    assert ingest(spark, tmp_shared, "b", "cb-new")["written"] == 1
    assert rows(spark.read.parquet(f"{tmp_shared}/target").select("id")) == [(1,), (2,), (3,), (3,), (4,)]


def test_a_batch_that_died_after_its_write_is_taken_once(spark, tmp_shared, monkeypatch):
    from loadkit.streaming import ingest as module

    drop(spark, f"{tmp_shared}/a/1", [1, 2, 3])
    real = module._Writer.write

    def written_then_dead(df, path, parts):
        real(df, path, parts)
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(module._Writer, "write", staticmethod(written_then_dead))
        with pytest.raises(Exception, match="killed"):
            ingest(spark, tmp_shared, "a", "ca")
    assert ingest(spark, tmp_shared, "a", "ca")["written"] == 3
    assert rows(spark.read.parquet(f"{tmp_shared}/target").select("id")) == [(1,), (2,), (3,)]


DIM = "k long, v string, effective_date date, end_date date, is_current int"


def dimension(spark):
    return spark.sql("""SELECT id AS k, concat('v', id) AS v, DATE '2024-01-01' AS effective_date,
                        DATE '9999-12-31' AS end_date, 1 AS is_current FROM range(200)""")


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(local_path(path)) for f in names if f.endswith(".parquet")}


def test_a_merge_writes_the_touched_buckets_only(spark, tmp_shared):
    target = dimension(spark)
    dim = buckets.create_bucketed(target, tmp_shared, ["k"], 16)
    before, old = files(tmp_shared), dim.folders()
    source = spark.createDataFrame([(7, "new")], "k long, v string")

    def merge(t, s):
        assert t.count() < 40  # only the bucket's rows are read
        return scd2_merge(t, s, ["k"], ["v"], "2024-06-01")

    touched = dim.merge(source, merge)
    assert len(touched) == 1
    new = dim.folders()
    assert {b for b in old if old[b] != new[b]} == set(touched)
    assert len(files(tmp_shared) - before) == 1 and before <= files(tmp_shared)
    assert rows(dim.read()) == rows(scd2_merge(target, source, ["k"], ["v"], "2024-06-01"))
    assert rows(dim.read(0)) == rows(target)  # earlier readers are undisturbed
    assert rows(buckets.open_bucketed(spark, tmp_shared).read()) == rows(dim.read())


def test_new_keys_empty_sources_and_new_dimensions(spark, tmp_shared):
    empty = spark.createDataFrame([], "k long, v string")
    dim = buckets.create_bucketed(empty, tmp_shared, ["k"], 4)
    assert dim.merge(empty, lambda t, s: scd1_merge(t, s, ["k"])) == [] and dim.version() == 0
    source = spark.range(50).select(F.col("id").cast("int").alias("k"), F.lit("x").alias("v"))  # another key type
    dim.merge(source, lambda t, s: scd1_merge(t, s, ["k"]))
    dim.merge(spark.createDataFrame([(3, "y"), (99, "z")], "k long, v string"), lambda t, s: scd1_merge(t, s, ["k"]))
    assert rows(dim.read()) == sorted([(k, "y" if k == 3 else "x") for k in range(50)] + [(99, "z")])


def test_of_two_merges_from_one_version_one_is_refused(spark, tmp_shared):
    dim = buckets.create_bucketed(spark.createDataFrame([(1, "a")], "k long, v string"), tmp_shared, ["k"], 4)
    source = spark.createDataFrame([(1, "b")], "k long, v string")

    def slow(t, s):
        buckets.open_bucketed(spark, tmp_shared).merge(source, lambda t, s: scd1_merge(t, s, ["k"]))
        return scd1_merge(t, s, ["k"])

    with pytest.raises(buckets.VersionConflict):
        dim.merge(spark.createDataFrame([(1, "c")], "k long, v string"), slow)
    assert rows(dim.read()) == [(1, "b")]


def test_dimension_loads_into_buckets(spark, tmp_shared):
    dim = buckets.create_bucketed(dimension(spark), f"{tmp_shared}/d", ["k"], 16)
    source = spark.createDataFrame([(7, "new", 1), (7, "newer", 2), (None, "x", 1)], "k long, v string, m int")
    out = loads.load_dimension_scd2(spark, source, table=dim, keys=["k"], tracked=["v"], order_columns=["m"],
                                    as_of="2024-06-01", audit=AuditTrail("d", batch_id="b"))
    assert out.metrics["buckets_written"] == 1 and out.output.count() == 201
    assert rows(out.output.filter("k = 7 and is_current = 1").select("v")) == [("newer",)]


def test_plain_append_is_as_before(spark, tmp_shared):
    df = spark.range(3)
    sinks.append(df, tmp_shared)
    sinks.append(df, tmp_shared)
    assert spark.read.parquet(tmp_shared).count() == 6
